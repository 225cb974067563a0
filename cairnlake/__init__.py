"""cairnlake: a Spark-native engine for governed object registries on a data lake."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions with the job; it needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
