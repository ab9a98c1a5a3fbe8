"""originflow: origination and lead-lag analytics over post streams, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Tasks carry the package's small helpers with them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
