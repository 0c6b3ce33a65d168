"""Registered-parent, matched-null field analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors then need no copy of the package: functions of its kernels travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
