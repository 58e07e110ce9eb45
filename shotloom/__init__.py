"""Shot-corpus analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry the package's code, so that nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
