"""Operators that prepare text corpora for language model training.

Functions that run in executors are shipped with the job, so executors need Spark's Python but not
this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
