"""Operators of a training-data pipeline; see the modules.

Functions of this package travel to the executors by value, so these need the
public libraries only, not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
