"""Operators for large training-data pipelines.  Nothing else in the library imports this subpackage.

Functions of this subpackage that run in tasks travel with the job, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
