"""Operations of a training-data pipeline, one module each; nothing outside this folder imports it.

Functions that run on executors are shipped by value, so that executors need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
