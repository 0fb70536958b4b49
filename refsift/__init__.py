"""refsift: bibliographic-evidence analytics on Spark DataFrames.

Functions that run in Python workers are sent to them by value, so the workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
