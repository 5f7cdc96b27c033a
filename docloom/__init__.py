"""docloom: corpus-scale document retrieval and analysis on Spark."""

import sys

from pyspark import cloudpickle

# Python helpers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
