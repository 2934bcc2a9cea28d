"""Operators for training-data pipelines; nothing else in the library imports this package."""

import placetrace.llm as _package
from pyspark import cloudpickle as _cloudpickle

# Executors get these functions with the job and need no copy of the package.
_cloudpickle.register_pickle_by_value(_package)
