"""Repeat-redemption detection for one-time offers, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel inside the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
