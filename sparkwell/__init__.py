"""sparkwell: PySpark-native analytics over the tool output and model usage of coding sessions."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
