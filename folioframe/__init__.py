"""Document-library analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from folioframe.session import configure, local_session

# Functions sent to Python workers travel by value, so the workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure", "local_session"]
