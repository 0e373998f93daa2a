"""Operators for preparing training text at scale: sharding, packing, scanning, deduplication, scoring, mixing.

Functions that run in Python workers are pickled with their code, so executors need no copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
