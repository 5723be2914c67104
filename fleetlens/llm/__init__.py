"""Operators of a training-data pipeline: filters, deduplication, decontamination, scans and mixing of a text corpus."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with their job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
