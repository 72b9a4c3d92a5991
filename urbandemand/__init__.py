"""Spark-first engine for city-scale transport demand."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the task, so that a cluster
# needs no copy of it on its own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
