"""Batch analytics over automated-test sessions, expressed as Spark DataFrames.

The few functions that run in Python workers are pickled by value, so executors
need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
