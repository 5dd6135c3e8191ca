"""Grounded meeting records as Spark jobs over tables of many meetings."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
