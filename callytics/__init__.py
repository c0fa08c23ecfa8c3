"""Call-centre analytics as Spark DataFrame and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

# Send the few Python functions that run in tasks along with the plan, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
