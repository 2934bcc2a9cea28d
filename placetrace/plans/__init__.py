"""Whole plans: the build, and the queries registered for checking."""
