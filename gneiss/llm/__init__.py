"""Operators for training-data pipelines. Nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Executors then need no copy of the package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
