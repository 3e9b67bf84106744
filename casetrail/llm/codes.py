"""Vector codes: parts of integer vectors replaced by the nearest entry of a codebook per part position.

Distances come from a lexicographic trie over the distinct parts of a block of rows: parts are sorted, nodes are common
prefixes, and the walk goes depth first over slices of at most ``SLICE`` nodes. A node holds the squared distances of
its prefix to all entries, so that a prefix is measured once however many parts begin with it; leaves take the smallest
and add their weighted components to the sums of that entry. A task sends one row per used entry to the next round,
never the parts themselves, so a vector that occurs a million times is one leaf with a weight.

Defined cases: rows whose vector is null or holds null, infinite or not-a-number components are dropped; shorter vectors
are filled with zeros to the longest kept one, and that to a multiple of ``PARTS``; codebooks hold as many entries as
rows are kept if those are fewer than ``ENTRIES``; of equal ids (null ids come last) the smaller vector goes first;
repeated rows are coded one by one; components beyond 2^40 count as 2^40, and sums beyond a long as the largest long;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casetrail.llm.common import plain, staged

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors whose parts share one trie.
BLOCK = 1 << 15
#: Nodes that are expanded together.
SLICE = 2048
FACTOR = 256.0
#: Components end here; up to EASY, whole vectors are measured in 64-bit integers.
LIMIT, EASY = 1 << 40, 1 << 24
LONG = (1 << 63) - 1
#: Rows that one label's total is joined with by one task: totals are repeated for so many salts.
SALTS = 32


# ---- the trie -----------------------------------------------------------------------------------


def _distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the place of every row among them, and how often each occurs."""
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    back = np.empty(len(rows), np.int64)
    back[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return rows[starts], back, np.diff(np.append(starts, len(rows)))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry (the lower of equals) and squared distance of sorted distinct ``parts``."""
    depth = parts.shape[1]
    entry, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
    # first[d]: rows at which a new prefix of d + 1 components begins
    new, first = np.zeros(len(parts), bool), []
    new[:1] = True
    for d in range(depth):
        new = new.copy()
        new[1:] |= parts[1:, d] != parts[:-1, d]
        first.append(np.flatnonzero(new))

    def descend(d: int, low: int, high: int, at: np.ndarray, far: np.ndarray) -> None:
        """Rows low..high hold the nodes that begin ``at`` and have d components; ``far`` are their distances."""
        if d == depth:
            entry[at] = far.argmin(1)
            error[at] = far[np.arange(len(at)), entry[at]]
            return
        a, b = np.searchsorted(first[d], (low, high))
        for k in range(a, b, SLICE):
            kids = first[d][k : min(k + SLICE, b)]
            parent = np.searchsorted(at, kids, side="right") - 1
            gap = parts[kids, d][:, None] - book[:, d][None, :]
            end = first[d][k + SLICE] if k + SLICE < b else high
            descend(d + 1, int(kids[0]), int(end), kids, far[parent] + gap * gap)

    if len(parts):
        root = np.zeros((1, len(book)), parts.dtype)
        descend(0, 0, len(parts), np.zeros(1, np.int64), root)
    return entry, error


def coded(rows: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per part position: distinct parts, their places, weights, entries and errors."""
    size = rows.shape[1] // PARTS
    for p in range(PARTS):
        parts, back, weight = _distinct(rows[:, p * size : (p + 1) * size])
        yield p, parts, back, weight, *nearest(parts, books[p])


def _exact(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in 64-bit integers where no sum can leave them, else as Python's unbounded ones."""
    reach = max((int(np.abs(a).max()) for a in (rows, books) if a.size), default=0)
    if 4 * reach * reach * max(rows.shape[1], 1) * 4 < LONG and reach <= EASY:
        return rows, books
    return rows.astype(object), books.astype(object)


# ---- rows ---------------------------------------------------------------------------------------


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and the integer components ``x`` of the rows that are coded."""
    v = plain(vectors, "vec_id", "embedding", "label")
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform("embedding", lambda e: F.floor(F.greatest(F.least(e.cast("double") * FACTOR, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))
    return v.filter(F.col("embedding").isNotNull() & fine).select("vec_id", "label", whole.alias("x"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to BLOCK rows: the larger a trie, the more prefixes are shared."""
    held, n = [], 0
    for batch in source:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks() if table.column(name).num_chunks != 1 else table.column(name).chunk(0)


# ---- learning and coding ------------------------------------------------------------------------


def first_books(kept: DataFrame, width: int) -> np.ndarray:
    """PARTS x entries x components, from the ENTRIES smallest ids."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()  # ENTRIES vectors
    rows = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        rows[i, : len(r.x)] = r.x
    return np.ascontiguousarray(rows.reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2))


def next_books(kept: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """One round: every used entry becomes the floored mean of its parts."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(source):
            rows, book = _exact(_matrix(_column(table, "x"), width), books)
            out: list[tuple] = []
            for p, parts, _, weight, entry, _ in coded(rows, book):
                n = np.bincount(entry, weight, minlength=book.shape[1]).astype(np.int64)
                sums = np.zeros((book.shape[1], parts.shape[1]), object if rows.dtype == object else np.int64)
                np.add.at(sums, entry, parts * weight[:, None])
                out += [(p, int(e), int(n[e]), [int(s) for s in sums[e]]) for e in np.flatnonzero(n)]
            p, e, n, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.int64()))], names=["p", "e", "n", "s"]
            )

    part = kept.select("x").mapInArrow(run, "p int, e int, n long, s array<long>")
    size = width // PARTS
    sums = [F.sum(F.element_at("s", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    out = books.copy()
    for r in part.groupBy("p", "e").agg(F.sum("n").alias("n"), *sums).collect():  # at most PARTS x ENTRIES rows
        out[r.p, r.e] = [int(r[f"s{i}"]) // r.n for i in range(size)]
    return out


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """Code, error, the errors of the label together, and the codebooks' digest, per kept row."""
    kept = kept_vectors(vectors)
    longest = kept.agg(F.max(F.size("x"))).first()[0]
    width = max(-(-(longest or 0) // PARTS), 1) * PARTS
    books = first_books(kept, width)
    for _ in range(ROUNDS if longest is not None else 0):
        books = next_books(kept, books, width)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(source):
            rows, book = _exact(_matrix(_column(table, "x"), width), books)
            error = np.zeros(len(rows), rows.dtype)
            code = np.zeros((len(rows), PARTS), np.uint8)
            for p, _, back, _, entry, far in coded(rows, book):
                code[:, p] = entry[back]
                error += far[back]
            text = code.tobytes().hex()
            cells = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            total = pa.array([min(int(x), LONG) for x in error] if rows.dtype == object else error, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [_column(table, "vec_id"), _column(table, "label"), pa.array(cells, pa.string()), total], names=["vec_id", "label", "code", "error"]
            )

    types = dict(kept.dtypes)
    out = staged(kept.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"), "vector-codes")
    # a label may hold a third of all rows: its total is repeated per salt, so that no task joins them all
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    totals = out.groupBy("label").agg(total.alias("label_error")).select(F.col("label").alias("_l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    joined = out.withColumn("_salt", salt).join(totals, F.col("label").eqNullSafe(F.col("_l")) & (F.col("_salt") == F.col("_s")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


ORACLE = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
parts AS (
  SELECT vec_id, p, x[p * len(x) // 16 + 1 : (p + 1) * len(x) // 16] AS v FROM kept, range(16) r(p)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
b0 AS (SELECT p, e, v FROM parts JOIN seeds USING (vec_id)),
a0 AS (SELECT p, t.v, n, arg_min(e, d * 64 + e) AS e FROM (
  SELECT t.p, t.v, t.n, b.e, list_sum(list_transform(list_zip(t.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM (SELECT p, v, count(*) AS n FROM parts GROUP BY p, v) t JOIN b0 b ON t.p = b.p) t GROUP BY p, t.v, n),
m0 AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS v FROM (
  SELECT p, e, i, sum(v[i] * n) AS s, sum(n) AS n FROM a0, range(1, 1 + (SELECT max(len(v)) FROM parts)) r(i) GROUP BY p, e, i) GROUP BY p, e),
b1 AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b0 b LEFT JOIN m0 m ON b.p = m.p AND b.e = m.e),
a1 AS (SELECT p, t.v, n, arg_min(e, d * 64 + e) AS e FROM (
  SELECT t.p, t.v, t.n, b.e, list_sum(list_transform(list_zip(t.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM (SELECT p, v, count(*) AS n FROM parts GROUP BY p, v) t JOIN b1 b ON t.p = b.p) t GROUP BY p, t.v, n),
m1 AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS v FROM (
  SELECT p, e, i, sum(v[i] * n) AS s, sum(n) AS n FROM a1, range(1, 1 + (SELECT max(len(v)) FROM parts)) r(i) GROUP BY p, e, i) GROUP BY p, e),
b2 AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b1 b LEFT JOIN m1 m ON b.p = m.p AND b.e = m.e),
a2 AS (SELECT p, t.v, min(d * 64 + e) AS best FROM (
  SELECT t.p, t.v, b.e, list_sum(list_transform(list_zip(t.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM (SELECT DISTINCT p, v FROM parts) t JOIN b2 b ON t.p = b.p) t GROUP BY p, t.v),
book AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM b2)),
codes AS (
  SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error
  FROM parts JOIN a2 USING (p, v) GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id) CROSS JOIN book
"""
