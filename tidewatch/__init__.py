"""Search, measure and rank weak periodic dips in large collections of time series, on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
