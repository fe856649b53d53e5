"""driftspark: a PySpark-native analytics engine for agent trajectories."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors
# need no copy of the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
