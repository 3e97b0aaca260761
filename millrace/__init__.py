"""millrace: reliable batch data pipelines on Spark DataFrames.

Python functions that run on executors are shipped by value, so workers need no copy of the library.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"
cloudpickle.register_pickle_by_value(sys.modules[__name__])
