"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions sent to workers travel with their code, so a worker needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
