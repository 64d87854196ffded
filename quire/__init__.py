"""Corpus packing and corpus analytics as PySpark DataFrame operators."""

from quire.options import PackOptions, SnapshotOptions

__all__ = ["PackOptions", "SnapshotOptions"]

import sys

from pyspark import cloudpickle

# Functions of this package are sent to the workers whole, so that workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
