"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this subpackage by value, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
