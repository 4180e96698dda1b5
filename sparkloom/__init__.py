"""A property-graph analytics engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get the package's functions by value, so clusters need no copy of it on their Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
