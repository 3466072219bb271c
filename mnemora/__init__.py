"""Spark-native engine for provenance-backed knowledge memory."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code, so nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
