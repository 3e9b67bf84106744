"""Best-fit packing: minimum bin slack.

Documents become token pieces of at most CAPACITY ids (only longer documents are cut). What packing needs to know is how
many pieces of each length there are: CAPACITY numbers at most, however large the corpus. On those, bins are
filled one after the other: the longest piece left opens a bin, and a bitset subset-sum over the lengths left
finds the fullest combination for the rest of it. The combination is used as often as the counts allow, so every
step uses up a length (or leaves fewer of it than one bin takes) and there are few distinct combinations. Pieces of one
length are then numbered in Spark (by ranges of a hash, so a frequent length is no hot spot) and the number says
which bin and place a piece takes.

Defined cases: a null or empty text is the single id END; rows that repeat are packed one by one; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casetrail.llm import tokens
from casetrail.llm.common import batches, running_total, spread, staged, text_of, uniform

CAPACITY = 4096
#: Texts that go through the tokenizer together.
TOGETHER = 64


def pieces(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        texts = batch.column("text").to_pylist()
        ids = (raw for i in range(0, len(texts), TOGETHER) for raw in tokens.encode(texts[i : i + TOGETHER], vocabulary))
        for doc, raw in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return batches(rows, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths (at most ``counts`` of each) with the largest sum up to ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0:
            size = min(size, left)
            new = (reach | (reach << (length * size))) & mask
            if new != reach:
                steps.append((reach, length, size))
                reach = new
            left -= size
            size *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, size in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + size
            at -= length * size
    return used


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how often, lengths of a bin), until all pieces are placed."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        first = max(left)
        left[first] -= 1
        used = fullest({k: n for k, n in left.items() if n > 0}, capacity - first) if capacity > first else {}
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, used))
    return out


def _places(found: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first number), and per key: pieces of that length a bin takes, first bin, first offset."""
    rows, number, bins = [], {}, 0
    for times, used in found:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, number.get(length, 0), n, bins, offset))
            number[length] = number.get(length, 0) + n * times
            offset += n * length
        bins += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (with doc_id, piece, length)."""
    cut = staged(cut.withColumn("_u", uniform(F.col("doc_id"), F.col("piece"), F.col("length"))), "pack-pieces")
    lengths = cut.groupBy("length").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["_n"] for r in lengths.collect()}  # at most ``capacity`` rows
    length, first, takes, start, offset = _places(combinations(counts, capacity))
    names = [c for c in cut.columns if c != "_u"]
    known = cut.sparkSession.createDataFrame([(int(k), int(n)) for k, n in counts.items()], "length long, _n long")
    numbered = running_total(
        cut.join(F.broadcast(known), "length").withColumns({"_parts": spread(F.col("_n")), "_one": F.lit(1)}),
        ["length"], "_u", "_parts", "_one", ["doc_id", "piece"], "_number",
    ).select(*names, "_number")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, number = (batch.column(c).to_numpy() for c in ("length", "_number"))
        lo, hi = np.searchsorted(length, size, "left"), np.searchsorted(length, size, "right")
        while (lo + 1 < hi).any():  # the last place of this length that starts at or before the number
            mid = (lo + hi) // 2
            up = (first[np.minimum(mid, len(first) - 1)] <= number) & (lo + 1 < hi)
            lo, hi = np.where(up, mid, lo), np.where(~up & (lo + 1 < hi), mid, hi)
        turn = number - first[lo]
        where = pa.array(start[lo] + turn // takes[lo]), pa.array(offset[lo] + turn % takes[lo] * size)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *where], names=[*names, "sequence_id", "offset"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "_u")
    return batches(numbered, make, f"{types}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, vocabulary, capacity), capacity)
