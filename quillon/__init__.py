"""quillon: entity-name matching and record linkage as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
