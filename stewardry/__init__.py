"""Data-governance operators for Spark: masking, lifecycle, audit, lineage, subject search,
erasure and disclosure. Every operator takes and returns DataFrames and takes its clock
(``as_of``) as an argument."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
