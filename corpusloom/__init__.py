"""corpusloom: corpus curation and evaluation operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
