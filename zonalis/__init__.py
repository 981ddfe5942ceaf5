"""Raster-to-zone analytics on Spark: pixel tables in, zone statistics and climate-zone classes out."""

import sys

from pyspark import cloudpickle

# The functions that run in tasks travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
