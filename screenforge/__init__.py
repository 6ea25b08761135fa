"""Profiling and perturbation-screen analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
