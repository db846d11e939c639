"""Operators for large training-data pipelines; nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel with their code: executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
