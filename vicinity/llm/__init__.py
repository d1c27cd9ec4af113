"""Operators for preparing training data; nothing else in the package imports this.

Functions of this subpackage travel to executors by value, so that a cluster
needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
