"""Statistical-catalog search, retrieval and corpus analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the jobs; it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
