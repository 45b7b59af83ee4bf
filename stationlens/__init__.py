"""Weather-station analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their tasks, so the
# package only has to be installed where the driver runs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
