"""Weather-station telemetry quality control as Spark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value, so a cluster needs no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
