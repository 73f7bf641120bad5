"""twinseek: hybrid (semantic + keyword) retrieval and retrieval evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel with the job, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
