"""flowsentry: network-flow attack detection on Spark DataFrames."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Task functions travel with the job, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
