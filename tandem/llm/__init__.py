"""Operators for training-data pipelines over tables of documents, pages and conversations."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
