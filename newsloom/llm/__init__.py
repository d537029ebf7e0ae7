"""Operators that prepare training text for language models. Nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with their tasks; executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
