"""Leakage-safe splitting, scoring and diagnostics of site-time observations on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
