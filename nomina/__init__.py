"""Name-matching analytics and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so that a cluster needs no copy
# of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
