"""Operators of a training-data pipeline; nothing outside this folder and corpus_pipeline.py imports them."""
import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with the task, so a cluster need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
