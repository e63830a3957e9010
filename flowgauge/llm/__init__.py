"""Operators of a training-data pipeline: each takes DataFrames and returns DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
