"""claimloom: causal-claim mining as lazily composed PySpark DataFrames.

Functions that run on executors are pickled by value, so a cluster needs no
copy of this package beside Python and numpy on its workers.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
