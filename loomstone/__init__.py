"""Loomstone: repository-history analytics as typed Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to Python workers by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
