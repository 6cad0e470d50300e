"""Spark-native retrieval analytics over document corpora."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so that workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
