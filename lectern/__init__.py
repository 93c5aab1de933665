"""Access-controlled, versioned, cited-corpus analytics on Spark.

Functions that run on executors are pickled by value, so a cluster needs no
copy of this package on its workers.
"""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
