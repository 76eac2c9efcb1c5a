"""Surveillance and space-traffic analytics as Spark DataFrame, SQL and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# the few functions that run in Python workers travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
