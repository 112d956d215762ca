"""Words of Arrow text columns, in slices of bounded size.

A word is a run of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 4 << 20


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def byte_sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of at most ``limit`` bytes; a longer text is a part of its own."""
    ends = np.cumsum(byte_sizes(texts))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words, the first word of each text (one entry more than texts), and the words by code."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.not_equal(flat, "")
    coded = flat.filter(full).dictionary_encode()
    counts = np.bincount(parent.filter(full).to_numpy(), minlength=len(texts))
    return coded.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(counts)]), coded.dictionary
