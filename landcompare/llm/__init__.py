"""Operators for training-data pipelines over documents, vectors, pages and benchmark items.

Functions that run in tasks travel by value, so executors need the usual libraries but no copy of this one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
