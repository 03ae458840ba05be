"""Structural-variant analytics over genome alignments, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# helpers used inside UDFs travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
