"""Spark-native analytics for multilingual dictionary data."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python tasks travel with their code, so executors
# need no copy of this package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
