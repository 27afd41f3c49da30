"""Corpus search, index maintenance and training-sample mining on Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers are shipped by value, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
