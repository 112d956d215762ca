"""Packing by minimum bin slack (Gupta and Ho, 1999).

Documents are tokenized and cut into full sequences and one remainder each. The remainders of a window of
consecutive rows are packed: for one sequence after the other, a subset-sum over bit sets finds the multiset
of remaining lengths that fills it closest to its capacity, and is traced back to counts of each length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .registry import query, table

SEQUENCE = 1024
WINDOW = 8192
SPECIAL = "<|endoftext|>"
PIECE = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, pad bigint"


def vocabulary() -> str:
    """Where the 50k byte-level vocabulary lies; its file of ranks has the ids of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """Text to token ids, equal to those of the tokenizers library: its special string is one token, 50256."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    made = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return lambda text: made.encode(text, allowed_special="all") if SPECIAL in text else made.encode_ordinary(text)


def best_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset of lengths, as (length, count), with the largest sum that is at most ``capacity``.

    Bit i of ``reach`` is set if some multiset sums to i. Lengths are tried from the longest, each split into
    powers of two of its count; the steps taken are kept, so the sum can be traced back. Stops once full.
    """
    reach, full, whole = 1, 1 << capacity, (1 << (capacity + 1)) - 1
    steps = []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & whole
            left -= part
            part *= 2
            if reach & full:
                break
        if reach & full:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            taken[length] = taken.get(length, 0) + part
    return sorted(taken.items(), reverse=True)


def fill_window(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences of places in ``lengths`` (each 1 to ``capacity``), each as full as the rest allows."""
    places: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        places.setdefault(lengths[i], []).append(i)
    counts = {x: len(p) for x, p in places.items()}
    out = []
    while counts:
        longest = max(counts)  # must go somewhere: the rest of its sequence is filled by the search
        row = [places[longest].pop()]
        _less(counts, longest, 1)
        if longest < capacity:
            for length, n in best_fill(counts, capacity - longest):
                row += [places[length].pop() for _ in range(n)]
                _less(counts, length, n)
        out.append(row)
    return out


def _less(counts: dict[int, int], length: int, n: int) -> None:
    counts[length] -= n
    if not counts[length]:
        del counts[length]


def _packer(path: str, capacity: int, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        number = TaskContext.get().partitionId() << 40
        rest: list[tuple] = []

        def pieces(rows: list[tuple]) -> pa.RecordBatch:
            key, start, ids, total, seq, offset, pad = zip(*rows)
            cols = [
                pa.array(key, key_type), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.tobytes() for x in ids], pa.binary()), *[pa.array(x, pa.int64()) for x in (total, seq, offset, pad)],
            ]
            return pa.RecordBatch.from_arrays(cols, ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "pad"])

        def packed() -> list[tuple]:
            nonlocal number
            rows = []
            for row in fill_window([len(r[2]) for r in rest], capacity):
                offset, pad = 0, capacity - sum(len(rest[i][2]) for i in row)
                for i in row:
                    rows.append((*rest[i], number, offset, pad))
                    offset += len(rest[i][2])
                number += 1
            rest.clear()
            return rows

        for batch in batches:
            key_type = batch.column(0).type
            rows, held = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                full = len(ids) // capacity * capacity
                for start in range(0, full, capacity):
                    rows.append((key, start, ids[start : start + capacity], len(ids), number, 0, 0))
                    number += 1
                if full < len(ids):
                    rest.append((key, full, ids[full:], len(ids)))
                held += len(ids)
                if len(rest) >= window:
                    rows += packed()
                if held > 1 << 20 and rows:
                    yield pieces(rows)
                    rows, held = [], 0
            if rows:
                yield pieces(rows)
        if rest:
            yield pieces(packed())
        pa.default_memory_pool().release_unused()  # the worker stays, for other tasks

    return run


def pack(
    docs: DataFrame, capacity: int = SEQUENCE, window: int = WINDOW, end_id: int = 0, key: str = "doc_id", text: str = "text",
    tokenizer: str | None = None,
) -> DataFrame:
    """Pieces of all documents: the key, start (its document's ids before it), length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset in the sequence (gapless from 0) and pad (ids its sequence lacks).

    Every document ends with ``end_id``, so one without text, NULL or empty, is a piece of one id. Documents
    longer than ``capacity`` fill sequences of their own; their remainders, and shorter documents, are packed
    in windows of ``window`` of them, in the order of the rows of a partition. The last sequences of a
    window may stay short: lengths spread evenly over 1 to 1,024 leave 60 to 92 of 4,130 with over 12 % padding. Rows are packed where they are read:
    nothing is shuffled. Repeated rows are packed as often as they occur. Sequence ids are unique, not gapless.
    An empty table gives no rows; other columns are left out. ``tokenizer``: a file of ranks.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    made = rows.mapInArrow(_packer(tokenizer or vocabulary(), capacity, window, end_id), f"key {rows.schema['key'].dataType.simpleString()}, {PIECE}")
    return made.withColumnRenamed("key", key)


def digest(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_packing")
def op7(spark, sf_dir):
    return digest(pack(table(spark, sf_dir, "documents")))
