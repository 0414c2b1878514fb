"""statloom: a Spark-native engine for multi-source event and performance statistics."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped by value, so that executors
# need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
