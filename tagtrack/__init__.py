"""Spark operators for radio-ranging positioning and player-motion analytics."""

import sys

from pyspark import cloudpickle

# the few task functions travel with the job; executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
