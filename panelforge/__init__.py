"""PySpark operators for feature engineering and model evaluation on large tables and streams."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
