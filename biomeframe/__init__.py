"""Sample x taxon abundance tables as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so the
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
