"""Operators for the preparation of training text; nothing else in the library imports them.

Their Python functions are pickled by value, so they travel with the job and executors need
no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
