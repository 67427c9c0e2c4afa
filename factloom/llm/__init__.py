"""Operators for preparing training text: near-duplicates, search, filters, sharding, packing, tokens.

Functions of this package travel to the executors by value, so a cluster needs only
the third-party libraries installed, not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
