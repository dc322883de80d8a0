"""Operators for training data: search, personal data, duplicates, extraction, contamination, language, toxicity, packing, shards."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value, so these need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
