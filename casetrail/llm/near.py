"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped candidates, links checked on full sets.

Every document gets BINS minima from a single hash of its shingles; empty bins borrow from others by optimal
densification (a hash of bin and attempt names the next bin to look into, until a filled one is met). BANDS bands of
ROWS minima are bucket keys: two sets of similarity 0.75 share no bucket with probability (1 - 0.75^4)^40 < 3e-7.

Documents with equal sets are one class from the start, so copies never meet in a bucket. A bucket proposes a star (each
member with one centre), never its pairs; stars that meet in fewer than MEETINGS buckets are left to the last step. A node
is first compared with one of its centres, then with those it is still apart from. Buckets of two bands together that
still hold more than one component propose once more: all members outside the centre's component with that centre, and
among themselves with one of their own.

Whatever single bands still hold in buckets of several components is then joined exactly: two sets of similarity 0.75 share
one of the shingles that come first in any fixed order (``prefixes``; the rarest come first). Pairs of different components
that share one, and whose sizes and places allow the similarity, are all judged; no pair that shares a bucket is left out.

Pairs are judged in two steps. A node carries PARITY bits, each the parity of the number of its shingles in one slot: the
bits in which two nodes differ are at most as many as the shingles that only one of them holds, so pairs that differ in
more bits than the similarity allows are dropped without their texts (``plausible``). The others are checked on whole sets.

Defined cases: null and empty texts have the empty set, are linked with nothing and kept; rows without doc_id are linked
with nothing; rows that repeat a doc_id are judged by their own texts, each text being a node of its own; further columns
are ignored; an empty table gives no rows; very long texts are compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from casetrail.llm.common import batches, staged, text_of, unused
from casetrail.llm.shingles import mix, shingle_set

BINS = 256
ROWS = 4
BANDS = 40
#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Centres that a bucket proposes in a round.
STARS = 2
#: Buckets in which a member and a centre must meet to be compared before the exact join.
MEETINGS = 2
#: Parity bits of a node. Any number is right; more of them tell longer texts apart.
PARITY = 1024
#: Slots in which shingles are counted for the order of prefixes; any order is right, a finer one gives fewer pairs.
SLOTS = 1 << 20


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of BINS bins; ``hashes`` is sorted and not empty. The top bits name the bin."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    first = np.searchsorted(hashes >> shift, np.arange(BINS, dtype=np.uint64))
    safe = np.minimum(first, len(hashes) - 1)
    filled = (hashes[safe] >> shift) == np.arange(BINS, dtype=np.uint64)
    out = hashes[safe]
    if filled.sum() == 1:
        return np.full(BINS, out[filled][0])
    empty = np.flatnonzero(~filled).astype(np.uint64)
    attempt = 0
    with np.errstate(over="ignore"):
        while len(empty):
            attempt += 1
            look = (mix(empty * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
            met = filled[look]
            out[empty[met].astype(np.int64)] = out[look[met]]
            empty = empty[~met]
    return out


def bands(hashes: np.ndarray) -> np.ndarray:
    rows = signature(hashes)[: BANDS * ROWS].reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount((hashes & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (tells the texts of one doc_id apart), n_shingles, set_id (equal sets, equal ids; null for the empty
    set), bands, parity."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, keys, odd = [], [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py())
            n.append(len(s))
            ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            keys.append(bands(s) if len(s) else None)
            odd.append(parity(s) if len(s) else None)
        longs = pa.list_(pa.int64())
        cols = [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, longs), pa.array(odd, longs)]
        names = ["doc_id", "text_id", "n_shingles", "set_id", "bands", "parity"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), *cols], names=names)

    return batches(_rows(docs), make, "doc_id long, text_id long, n_shingles long, set_id binary, bands array<long>, parity array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("text_id", F.xxhash64("text"))


def plausible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """``pairs`` (a, b) without those whose sizes or parities rule the similarity out; ``marks`` has (node, n, parity).

    Links have |A| + |B| >= (100 + THRESHOLD) / (100 - THRESHOLD) times the shingles that only one of both holds."""
    differ = " + ".join(f"bit_count(a_parity[{k}] ^ b_parity[{k}])" for k in range(PARITY // 64))
    fits = F.expr(
        f"100 * least(a_n, b_n) >= {THRESHOLD} * greatest(a_n, b_n) and {100 + THRESHOLD} * ({differ}) <= {100 - THRESHOLD} * (a_n + b_n)"
    )
    a, b = (marks.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("parity").alias(f"{s}_parity")) for s in "ab")
    return pairs.join(a, "a").join(b, "b").filter(fits).select(*pairs.columns)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b), those whose full sets are alike; ``texts`` has (node, text). A frequent ``b`` is a skewed
    join, which Spark splits; its set is made once for the pairs that follow one another."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        alike, last, q = [], None, None
        for x, y, b in zip(batch.column("ta"), batch.column("tb"), batch.column("b").to_pylist(), strict=True):
            if b != last or q is None:
                last, q = b, shingle_set(y.as_py())
            p = shingle_set(x.as_py())
            both = len(np.intersect1d(p, q, assume_unique=True))
            alike.append(100 * both >= THRESHOLD * (len(p) + len(q) - both) and both > 0)
        return batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return staged(batches(with_both.select("a", "b", "ta", "tb"), compare, "a long, b long").distinct(), "near-links")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for all nodes of ``edges`` (a, b): alternating large and small stars."""
    e = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = now
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(down.union(low.select("a", F.col("m").alias("b"))).distinct(), "near-edges")


def relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels (node, label) after the links ``found`` (a, b); nodes without a label are their own.

    Only the graph of labels is searched, which is much smaller than that of nodes."""
    own = F.coalesce("label", "node")
    a = found.join(labels.withColumnRenamed("node", "a"), "a", "left").select("a", "b", F.coalesce("label", "a").alias("la"))
    ties = a.join(labels.withColumnRenamed("node", "b"), "b", "left").select("a", "b", "la", F.coalesce("label", "b").alias("lb"))
    ties = staged(ties, "near-ties")
    merged = components(ties.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    met = ties.select(F.col("a").alias("node")).union(ties.select("b")).distinct()
    every = labels.join(met, "node", "full_outer").select("node", own.alias("label"))
    to = merged.select(F.col("node").alias("label"), F.col("label").alias("_to"))
    return staged(every.join(to, "label", "left").select("node", F.coalesce("_to", "label").alias("label")), "near-labels")


def crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components."""
    a = pairs.join(labels.withColumnRenamed("node", "a"), "a", "left").select("a", "b", F.coalesce("label", "a").alias("la"))
    both = a.join(labels.withColumnRenamed("node", "b"), "b", "left").select("a", "b", "la", F.coalesce("label", "b").alias("lb"))
    return both.filter("la <> lb").select("a", "b")


def _stars(rows: DataFrame, seed: int) -> DataFrame:
    """Pairs to check in buckets of several components: (band, node, label) in, (a, b) out. STARS centres of a bucket are
    each paired with the members outside their component, and one of those outside the first with the rest of them."""
    orders = [F.xxhash64(F.lit(seed * STARS + k), "node") for k in range(STARS)]

    def drawn(rows: DataFrame, n: int) -> DataFrame:
        centre = rows.groupBy("band").agg(
            F.array(
                *[F.struct(F.lit(k).alias("k"), F.min_by("node", o).alias("b"), F.min_by("label", o).alias("of")) for k, o in enumerate(orders[:n])]
            ).alias("_c")
        )
        met = rows.join(staged(centre, "near-centres"), "band")
        other = met.withColumn("_c", F.filter("_c", lambda c: c["of"] != F.col("label")))
        return other.select("band", "node", "label", F.explode("_c").alias("_c")).select("band", "node", "label", "_c.k", "_c.b")

    outside = staged(drawn(rows, STARS), "near-outside")
    among = drawn(outside.filter("k = 0").select("band", "node", "label"), 1)
    return outside.select("node", "b").union(among.select("node", "b")).select(
        F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")
    ).distinct()


def _levels(texts: DataFrame) -> np.ndarray:
    """How frequent the shingles of each slot are, in steps of a quarter of a power of two."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in source:
            for text in batch.column("text"):
                np.add.at(total, _slot(shingle_set(text.as_py())), 1)
        met = np.flatnonzero(total)
        for k in range(0, len(met), 1 << 16):
            part = met[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["slot", "n"])

    n = texts.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = n.select("slot", F.round(4 * F.log2("n")).cast("short").alias("level")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[got.column("slot").to_numpy()] = got.column("level").to_numpy()
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) % np.uint64(SLOTS)).astype(np.int64)


def prefixes(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """node, n, shingle, place: of every set, as many shingles as it takes to share one with any set that is alike."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, hashes, places = [], [], [], []
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
            s = shingle_set(text.as_py())
            n = len(s)
            first = s[np.lexsort((s, levels[_slot(s)]))][: n - (THRESHOLD * n + 99) // 100 + 1]
            nodes.append(np.full(len(first), node, np.int64))
            sizes.append(np.full(len(first), n, np.int64))
            hashes.append(first.view(np.int64))
            places.append(np.arange(len(first), dtype=np.int64))
        cols = [pa.array(np.concatenate(x)) for x in (nodes, sizes, hashes, places)]
        return pa.RecordBatch.from_arrays(cols, names=["node", "n", "shingle", "place"])

    return batches(texts.select("node", "text"), make, "node long, n long, shingle long, place long")


def _exact(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components, of the nodes of ``texts``, that may be alike."""
    own = F.coalesce("label", "node").alias("label")
    firsts = prefixes(texts, _levels(texts)).join(labels, "node", "left").select("shingle", "node", own, "n", "place")
    firsts = staged(firsts, "near-prefixes")
    # the component that holds most of a shingle's nodes is never paired with itself
    held = firsts.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("held"))
    most = held.groupBy("shingle").agg(F.max_by("label", F.struct("held", "label")).alias("most"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = staged(firsts.join(most.drop("k"), "shingle"), "near-shingles")
    x = met.filter("label <> most").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("node", "label", "n", "place")])
    y = met.select("shingle", "most", *[F.col(c).alias(f"y_{c}") for c in ("node", "label", "n", "place")])
    apart = F.expr("x_label <> y_label and (y_label = most or x_node < y_node)")
    # what both still hold from the shared shingle on is the most they can share
    fits = F.expr(
        f"{100 + THRESHOLD} * least(x_n - x_place, y_n - y_place) >= {THRESHOLD} * (x_n + y_n)"
        f" and 100 * least(x_n, y_n) >= {THRESHOLD} * greatest(x_n, y_n)"
    )
    pairs = x.join(y, "shingle").filter(apart & fits)
    return pairs.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).distinct()


def _finished(texts: DataFrame, marks: DataFrame, nodes: DataFrame, labels: DataFrame, checked: DataFrame) -> DataFrame:
    """Labels after all links among ``nodes``: one pair of each node and component first, then those still apart."""
    left = plausible(_exact(texts.join(nodes, "node", "left_semi"), labels), marks)
    left = staged(left.join(checked, ["a", "b"], "left_anti"), "near-pairs")
    with_label = left.join(labels.withColumnRenamed("node", "b"), "b", "left").select("a", "b", F.coalesce("label", "b").alias("of"))
    first = staged(with_label.groupBy("a", "of").agg(F.min("b").alias("b")).select("a", "b"), "near-pairs")
    for pairs in (first, left.join(first, ["a", "b"], "left_anti")):
        found = confirm(staged(crossing(pairs, labels), "near-pairs"), texts)
        if not found.isEmpty():
            labels = relabelled(labels, found)
    return labels


def _classes(known: DataFrame) -> DataFrame:
    """set_id, doc_id and text_id of the first row, node, bands, parity, n of every class of equal sets. The node is that doc_id; of
    several classes with one doc_id all but one get a negative number made of the set instead."""
    rows = known.filter("set_id is not null and doc_id is not null")
    classes = rows.groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_id")).alias("_first"),
        F.first("bands").alias("bands"),
        F.first("parity").alias("parity"),
        F.first("n_shingles").alias("n"),
    )
    classes = staged(classes.select("set_id", "_first.*", "bands", "parity", "n"), "near-classes")
    several = classes.groupBy("doc_id").agg(F.min("set_id").alias("_own"), F.count(F.lit(1)).alias("_k")).filter("_k > 1").drop("_k")
    other = F.col("_own").isNotNull() & (F.col("set_id") != F.col("_own"))
    node = F.when(other, F.xxhash64("set_id").bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("doc_id"))
    return staged(classes.join(several, "doc_id", "left").withColumn("node", node).drop("_own"), "near-classes")


def component_labels(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, label of the nodes that are linked with another."""
    keys = classes.select("node", "n", F.explode("bands").alias("band"))
    met = keys.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("band")
    shared = staged(keys.join(staged(met, "near-met"), "band"), "near-shared")
    order = F.xxhash64(F.lit(0), "node")
    centres = shared.groupBy("band").agg(
        F.min_by("node", order).alias("centre"), F.min_by("n", order).alias("n_centre"), F.min(order).alias("place")
    )
    fits = F.expr(f"100 * least(n, n_centre) >= {THRESHOLD} * greatest(n, n_centre)")
    stars = shared.join(staged(centres, "near-centres"), "band").filter(fits & (F.col("node") != F.col("centre")))
    stars = stars.groupBy(F.col("node").alias("a"), F.col("centre").alias("b")).agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("met"))
    known = staged(classes.join(shared.select("node").distinct(), "node", "left_semi"), "near-known")
    marks = known.select("node", "n", "parity")
    stars = staged(plausible(stars.filter(F.col("met") >= MEETINGS).drop("met"), marks), "near-stars")
    wanted = known.select("doc_id", "text_id", "node")
    texts = staged(_rows(docs).join(wanted, ["doc_id", "text_id"]).select("node", "text"), "near-texts")
    # first one centre each, then the other centres of nodes that are still apart from them
    first = staged(stars.groupBy("a").agg(F.min_by("b", "place").alias("b")), "near-pairs")
    none = first.sparkSession.createDataFrame([], "node long, label long")
    labels = relabelled(none, confirm(first, texts))
    rest = staged(crossing(stars.select("a", "b"), labels).join(first, ["a", "b"], "left_anti"), "near-pairs")
    labels = relabelled(labels, confirm(rest, texts))
    checked = first.union(rest).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # two bands together make buckets that hold little but true neighbours
    fine = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(bands[i], bands[(i + 1) % {BANDS}]))")
    paired = _open(known.select("node", F.explode(fine).alias("band")), labels)
    new = staged(plausible(_stars(paired, 0), marks).join(checked, ["a", "b"], "left_anti"), "near-pairs")
    found = confirm(new, texts)
    labels = relabelled(labels, found)
    return _finished(texts, marks, _open(shared, labels).select("node").distinct(), labels, checked.union(new))


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """band, node, label of the buckets (band, node) that hold several components."""
    placed = rows.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    placed = staged(placed, "near-placed")
    mixed = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band")
    return staged(placed.join(mixed, "band"), "near-open")


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, n_shingles of all rows, and the first row (doc_id, text_id) of their component; null for the empty set."""
    known = staged(sketches(docs), "near-sketches")
    classes = _classes(known)
    labels = component_labels(docs, classes)
    linked = classes.select("node", "doc_id", "text_id").join(labels, "node")
    first = staged(linked.groupBy("label").agg(F.min(F.struct("doc_id", "text_id")).alias("first")), "near-smallest")
    comps = labels.join(first, "label").select("node", "first")
    own = F.struct("doc_id", "text_id")
    by_set = staged(classes.join(comps, "node", "left").select("set_id", F.coalesce("first", own).alias("first")), "near-classes")
    return known.select("doc_id", "text_id", "n_shingles", "set_id").join(by_set, "set_id", "left").drop("set_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    return _judged(docs).select("doc_id", "n_shingles", comp.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: the first one of each component, with all its columns. Rows with the same doc_id and
    text are one; other rows go only where a linked or equal text stays. Rows without doc_id all stay."""
    gone, same, first = (unused(docs, n) for n in ("_gone", "_same", "_first"))
    apart = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("text_id") != F.col("first.text_id"))
    out = _judged(docs).filter(F.col("doc_id").isNotNull() & apart)
    out = out.select(F.col("doc_id").alias(gone), F.col("text_id").alias(f"{gone}_text")).distinct()
    left = docs.withColumn(same, F.xxhash64(text_of()))
    left = left.join(out, (F.col("doc_id").cast("long") == F.col(gone)) & (F.col(same) == F.col(f"{gone}_text")), "left_anti")
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    spread = F.when(F.col("doc_id").isNull(), whole)  # rows without doc_id are no group
    number = F.row_number().over(Window.partitionBy("doc_id", same, spread).orderBy(whole))
    return left.withColumn(first, number).filter((F.col(first) == 1) | F.col("doc_id").isNull()).drop(first, same)
