"""Operators of a training-data pipeline; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Workers get these modules' functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
