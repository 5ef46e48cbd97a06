"""Gridloom: sparse matrices, graphs and clusterings as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel to the workers by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
