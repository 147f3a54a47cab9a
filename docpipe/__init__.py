"""docpipe: document conversion and ledger analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "1.0.0"

# Python helpers travel inside the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
