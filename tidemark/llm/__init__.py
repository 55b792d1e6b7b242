"""Operators of a training-data pipeline over documents, embeddings and pages.

Nothing else in the library imports this subpackage. Functions that run in
Python tasks are sent by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
