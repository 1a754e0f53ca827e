"""Training-data operators: mixing, sharding, quality, safety, deduplication, archives."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
