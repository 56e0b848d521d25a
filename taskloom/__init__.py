"""Workflow discovery over activity events, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the tasks, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
