"""Operators for training corpora: cleaning, joining, searching, mixing and packing documents and vectors."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with the job, so workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
