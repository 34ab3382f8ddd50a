"""Spark-native discovery of personal data in files and text tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python tasks travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
