"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Nothing else in the library imports this subpackage. Functions of it that run inside tasks are
pickled by value, so executors need only the third-party packages, not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
