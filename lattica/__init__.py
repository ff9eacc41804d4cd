"""Multivariate analysis of samples-by-variables data, on Spark DataFrames.

Functions that run in Python workers travel by value, so that executors need no
installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
