"""tallyframe: composition analytics on Spark DataFrames.

A *composition table* has one row per (group, category) with a count, for
example the prey items found in one diet.  Every operator is a plain function
from DataFrames to a DataFrame, parameterised by column names.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their tasks, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
