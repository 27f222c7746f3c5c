"""Content-intelligence jobs on Spark DataFrames: chunk, embed, search, deduplicate, cluster and report."""

import sys

from pyspark import cloudpickle

# Helpers that run inside Python workers travel with the task, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
