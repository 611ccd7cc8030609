"""Operators of a training-data pipeline and their queries."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tenderlens.llm import exact_dedup, mixing, near_dup, quality_lines, secret_scan  # noqa: E402, F401  (they register queries)
from tenderlens.llm import pivot_clusters, revisits, suffix_dedup, turn_repair, token_count, token_shards, toxicity, unigram  # noqa: E402, F401
from tenderlens.llm.registry import ORACLES, QUERIES  # noqa: E402

__all__ = ["ORACLES", "QUERIES"]
