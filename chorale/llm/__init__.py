"""Operators for training-data pipelines at scale; nothing else in the library imports this subpackage.

Functions that run in tasks are sent by value: executors need Python and its libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
