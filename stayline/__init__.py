"""Analytics over tables of repeated, labelled recordings of the same subjects, on PySpark.

Every operator takes and returns DataFrames (or Columns). All are lazy apart
from the writers, the vocabulary loader, model fitting and small jobs where the
plan depends on the data.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
