"""Training-data operators for large text corpora, one module per operator.

The functions that run inside tasks travel by value, so executors need the
third-party libraries but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
