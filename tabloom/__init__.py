"""tabloom: profile, repair, synthesise and score messy tables with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need pandas and numpy but no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
