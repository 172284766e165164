"""A PySpark-native analytics engine."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors whole, so none of them needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
