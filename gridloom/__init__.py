"""Array analytics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# executors get the functions themselves, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
