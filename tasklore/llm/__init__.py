"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

Functions that run in executors are pickled by value, so a job does not need the package installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
