"""Operators for building training corpora; one module per operator, queries in ``queries``."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so these need numpy and arrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
