"""markweave: registry-record analytics as PySpark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# Tasks get the library's functions with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
