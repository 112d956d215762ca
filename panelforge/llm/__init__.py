"""Operators for preparing training text, one module each, with their registered queries."""

from .registry import ORACLE, QUERIES  # noqa: F401
from . import (  # noqa: F401
    chat, collocations, decontaminate, jaccard_join, line_dedup, packing, prefix_trie, quality_classifier, quality_rules, secret_scan, sharding, token_counts, url_filter,
)  # noqa: F401
