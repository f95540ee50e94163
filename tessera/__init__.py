"""Array analytics and training-data processing on Spark."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
