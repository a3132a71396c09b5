"""quarry: corpus metrics, clone and report analytics on Spark DataFrames.

Every public function takes DataFrames (and plain parameters) and returns a
DataFrame. Nothing is collected to the driver inside the library.
"""

import sys as _sys

__version__ = "0.1.0"

# Python steps (mapInPandas) ship their functions to the executors by value,
# so workers need no installed copy of this package.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover
    pass
