"""Corvane: a Spark-first engine for corpora of public enquiries and their official replies."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to executors carry their code: a cluster needs no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
