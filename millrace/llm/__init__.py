"""Training-data operators: de-duplication, decontamination, mixing, scoring and scans.

Nothing else in the library imports this subpackage. Functions that run on executors are
shipped by value, so that workers need numpy and pyarrow but not this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
