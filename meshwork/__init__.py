"""Graph placement analytics on Spark: partitioning, process mapping, dynamic graphs.

Functions of this package that run on executors travel inside the task (pickled by value), so a cluster needs no copy of
the package on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
