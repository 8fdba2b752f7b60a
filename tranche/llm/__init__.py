"""Operators for training-data corpora; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Tasks get these functions by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
