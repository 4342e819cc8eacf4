"""Curation and evaluation of multilingual speech-and-text corpora on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Arrow functions travel with the query: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
