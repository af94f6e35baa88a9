"""Operators for training-data pipelines: filters, search, fingerprints, deduplication, mixing."""

import sys

from pyspark import cloudpickle

# functions travel to the executors with their code, so that workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
