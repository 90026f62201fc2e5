"""wakeline: how content and audience sentiment travel across platforms, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to workers carry their code with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
