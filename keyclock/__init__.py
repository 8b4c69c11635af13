"""Event-time analytics on keyed streams in which every key keeps its own clock."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel by value, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
