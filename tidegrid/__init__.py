"""tidegrid: keyed time-series feature engineering and forecasting on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so that workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
