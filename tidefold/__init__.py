"""Ordered, per-key stateful analytics on Spark DataFrames and streams.

Functions of this package that run on executors travel with the task, so
executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
