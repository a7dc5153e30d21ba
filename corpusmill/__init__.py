"""Spark-native corpus preparation, retrieval, graph and observability operators."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks carry their code along, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
