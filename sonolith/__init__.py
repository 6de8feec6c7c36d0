"""Spark-native analytics over libraries of sampled signals, and corpus operators for training data.

Functions of this package that run in Python workers are shipped by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
