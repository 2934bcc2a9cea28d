"""Entity history from trip archives, as Spark DataFrames.

Trips are normalised, rolled up per file to observations, resolved to places,
and reconciled with current inventories.  Every step takes and returns a lazy
DataFrame; see ``placetrace.plans.build`` for the whole build.
"""
