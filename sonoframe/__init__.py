"""Spark jobs for labelled series: framing, quality, grouping, scoring, streams, audits.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing runs until an action, except the few operators that have to
fit something first; those say so in their docstring.
"""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so these need numpy and arrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
