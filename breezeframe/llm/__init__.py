"""Operators for training-data pipelines; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value, so a worker needs no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
