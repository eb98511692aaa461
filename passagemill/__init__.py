"""Passage mill: a Spark-first engine for curating question-passage training data."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry the library's code with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
