"""Prefix trie of conversations: which beginnings are shared, by whom, and what sharing them saves.

Conversations are rebuilt (a common opening, then their own turns) and stored in blocks of ``BLOCK`` turns. The digest of
a prefix is a running combination of the digests of its turns with their places. A count-min sketch of all prefix
digests is then consulted: where a cell was hit once, its prefix has one member, and so has every longer one; these tails
become nodes on the spot. Only prefixes that may be shared are shuffled and grouped exactly. Sums over subtrees need no
walk up the trie: every node is credited to its smallest member, and a node adds up what its members hold from its depth
on.

Scale: the sketch is two bitmaps of cells hit once, of ``CELLS`` bits each at most (32 MB together); beyond that size it
screens less and the result stays the same. Prefixes shared by more than a ten-thousandth of all shared rows (so fewer than
10,000 of them) are joined by broadcast, the others by a shuffle. Long conversations are cut into blocks, and lists of ids
into chunks of neighbouring ids that are hashed as a stream.

Defined cases: null roles and texts are empty; turns go by number, null first, equal numbers by the SHA-256 of role and
text; repeated rows are turns of their own; rows without conv_id belong to no conversation; turns may be of any length and
conversations may have any number of them; an empty table gives no node; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from casetrail.llm.common import batches, plain, staged, text_of

OPENERS, LONGEST_OPENING = 100, 6
#: Turns of a conversation that one row holds.
BLOCK = 4096
#: Neighbouring ids whose decimal forms make one chunk.
CHUNK = 4096
#: Cells of one row of the sketch, as a power of two: at least, at most.
CELLS = (10, 27)
#: Bits of one row of Spark's bitmap functions.
BITMAP = 32768
#: A prefix with more than this share of all shared rows is joined by broadcast.
HOT_SHARE = 10_000

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n long"


# ---- rebuilt conversations ----------------------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place (from 0), and the length of every conversation. Sorted in ranges: a conversation may span
    many, and its later ranges go on where the earlier ones end."""
    role, text = text_of("role"), text_of("text")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = plain(conversations, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    turns = turns.select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    row = turns.withColumn("_row", F.monotonically_increasing_id())  # spreads copies of one row as well
    cut = staged(row.repartitionByRange("conv_id", "turn", "digest", "_row").withColumn("_part", F.spark_partition_id()), "turns")
    counts = cut.groupBy("_part", "conv_id").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", "conv_id", earlier.alias("_earlier")).filter("_earlier > 0")  # fewer than ranges
    inside = Window.partitionBy("_part", "conv_id").orderBy("turn", "digest", "_row")
    pos = F.row_number().over(inside) - 1 + F.coalesce(F.col("_earlier"), F.lit(0))
    out = cut.join(F.broadcast(offsets), ["_part", "conv_id"], "left").select("conv_id", pos.cast("long").alias("pos"), "digest", "chars")
    return out, counts.groupBy("conv_id").agg(F.sum("_n").alias("own"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Per conversation and block: ``n`` (turns in all) and its turns (depth, digest, code points); depth 0 is the root."""
    turns, sizes = numbered_turns(conversations)
    turns = staged(turns, "numbered-turns")
    h = (F.crc32(F.col("conv_id").cast("string")) % LONGEST_OPENING).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % OPENERS).alias("base")
    sizes = staged(sizes.select("conv_id", "own", h, base), "conversation-sizes")
    openers = sizes.filter(F.col("conv_id") % OPENERS == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("_lent"))
    lent = F.least(F.col("h"), F.coalesce(F.col("_lent"), F.lit(0)))
    convs = sizes.join(openers, "base", "left").select("conv_id", "own", "base", "h", lent.alias("lent"))
    convs = convs.withColumn("n", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))

    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("own") - 1) / BLOCK))
    info = convs.select("conv_id", F.explode(blocks).alias("_b"), "h", "lent", "n")
    own = (
        turns.withColumn("_b", F.floor(F.col("pos") / BLOCK))
        .join(info, ["conv_id", "_b"])
        .filter(F.col("pos") >= F.col("h"))
        .select("conv_id", (F.col("lent") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "chars", "n")
    )
    first = turns.filter((F.col("conv_id") % OPENERS == 0) & (F.col("pos") < LONGEST_OPENING)).withColumnRenamed("conv_id", "base")
    taken = first.join(convs, "base").filter(F.col("pos") < F.col("lent"))  # at most 199 conversations share an opener
    taken = taken.select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "chars", "n")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("00" * 16)).alias("digest"), F.lit(0).cast("long").alias("chars"), "n")
    return (
        own.unionByName(taken)
        .unionByName(roots)
        .groupBy("conv_id", F.floor(F.col("depth") / BLOCK).alias("block"))
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("depth", "digest", "chars"))).alias("turns"))
    )


# ---- digests of prefixes ------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefixes(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Flat arrays over the turns of all rows: row number, depth, code points, and the 128-bit digest of the prefix (a, b)."""
    lists = batch.column("turns")
    sizes = np.asarray(lists.value_lengths(), np.int64)
    turns = lists.flatten()
    depth = turns.field("depth").to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(turns.field("digest").to_pylist()), "<u8").reshape(-1, 2)
    d = depth.astype(np.uint64)
    with np.errstate(over="ignore"):
        a = _mixed(raw[:, 0] ^ _mixed(raw[:, 1] + d * _K1))
        b = _mixed(raw[:, 1] ^ _mixed(raw[:, 0] + d * _K2))
    root = depth == 0
    a[root], b[root] = 0, 0
    row = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    out = {"row": row, "depth": depth, "chars": turns.field("chars").to_numpy(zero_copy_only=False), "begins": begins, "sizes": sizes}
    for name, x in (("a", a), ("b", b)):
        run = np.bitwise_xor.accumulate(x) if len(x) else x
        before = np.where(begins > 0, run[np.maximum(begins, 1) - 1], np.uint64(0)) if len(run) else np.zeros(len(begins), np.uint64)
        if f"carry_{name}" in batch.schema.names:
            before = before ^ batch.column(f"carry_{name}").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        out[name] = run ^ before[row]
    return out


def _with_carries(blocks: DataFrame) -> DataFrame:
    """Later blocks of a long conversation start from the digest of the earlier ones."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = _prefixes(batch)
        ends = p["begins"] + p["sizes"] - 1
        return pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("block"), *[pa.array(p[x][ends].view(np.int64)) for x in "ab"]], names=["conv_id", "block", "xa", "xb"]
        )

    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = batches(blocks.filter(F.col("n") >= BLOCK), make, "conv_id long, block long, xa long, xb long").select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(f"x{x}").over(earlier), zero).alias(f"carry_{x}") for x in "ab"]
    )
    return blocks.join(sums, ["conv_id", "block"], "left").withColumns({f"carry_{x}": F.coalesce(F.col(f"carry_{x}"), zero) for x in "ab"})


# ---- the sketch ---------------------------------------------------------------------------------


def _cells(p: dict[str, np.ndarray], at: np.ndarray, power: int) -> list[np.ndarray]:
    """The cell of every chosen prefix in either row of the sketch."""
    shift = np.uint64(64 - power)
    return [(p["a"][at] >> shift).astype(np.int64), (p["b"][at] >> shift).astype(np.int64) + (1 << power)]


def sketch(blocks: DataFrame, power: int) -> np.ndarray:
    """Bytes of a bitmap over the cells of both rows: set where exactly one prefix was counted."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = _prefixes(batch)
        cell, n = np.unique(np.concatenate(_cells(p, p["depth"] > 0, power)), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])

    once = batches(blocks, make, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n = 1")
    at = F.col("cell") + 1
    maps = once.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((max((2 << power) // BITMAP, 1), BITMAP // 8), np.uint8)
    for r in maps.toLocalIterator():  # two rows of at most 2^27 bits
        out[r.bucket - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel()


def _single(p: dict[str, np.ndarray], bits: np.ndarray, power: int) -> np.ndarray:
    """True where the smaller count is one: no other conversation begins like this."""
    out = p["depth"] > 0
    hit = np.zeros(len(out), bool)
    for cell in _cells(p, slice(None), power):
        hit |= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return out & hit


# ---- the trie -----------------------------------------------------------------------------------


def _empty() -> Column:
    return F.lit(hashlib.sha256(b"").hexdigest())


def _end_digests(ends: DataFrame) -> DataFrame:
    """``ends_sha256`` per node, from (conv_id, depth, member): chunks of neighbouring ids, hashed in order as a stream."""
    chunk = F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ",").alias("chunk")
    chunks = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / CHUNK).alias("c")).agg(chunk)  # at most CHUNK ids

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def emit() -> pa.RecordBatch:
            c, d, s = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(s)], names=["conv_id", "depth", "ends_sha256"])

        for batch in source:
            for c, d, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "depth", "chunk")], strict=True):
                if (c, d) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (c, d), hashlib.sha256()
                state.update(text.encode())
            if done:
                yield emit()
                done = []
        if key:
            done.append((*key, state.hexdigest()))
            yield emit()

    ordered = chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "c")
    return ordered.select("conv_id", "depth", "chunk").mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _with_members(shared: DataFrame) -> DataFrame:
    """Adds the smallest member, the number of members and that of longer ones to every row of a shared prefix."""
    nodes = staged(
        shared.groupBy("a", "b", "depth").agg(F.min("conv_id").alias("top"), F.count(F.lit(1)).alias("size"), F.count_if(F.col("n") > F.col("depth")).alias("longer")),
        "shared-prefixes",
    )
    rows = nodes.agg(F.sum("size")).first()[0] or 0
    hot = nodes.filter(F.col("size") > rows / HOT_SHARE)  # fewer than HOT_SHARE rows: their sizes add up to at most ``rows``
    keys = ["a", "b", "depth"]
    first = shared.join(F.broadcast(hot), keys, "left")
    cold = first.filter("top is null").drop("top", "size", "longer").join(nodes.filter(F.col("size") <= rows / HOT_SHARE), keys)
    return first.filter("top is not null").unionByName(cold)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node; see the module."""
    blocks = staged(_with_carries(staged(rebuilt(conversations), "rebuilt")), "rebuilt-carried")
    count = blocks.agg(F.sum(F.size("turns"))).first()[0] or 0
    power = min(max((4 * count).bit_length(), CELLS[0]), CELLS[1])
    bits = blocks.sparkSession.sparkContext.broadcast(sketch(blocks, power))

    def firsts(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = _prefixes(batch)
        at = np.flatnonzero(_single(p, bits.value, power))
        conv = batch.column("conv_id").to_numpy()[p["row"][at]]
        return pa.RecordBatch.from_arrays([pa.array(conv), pa.array(p["depth"][at])], names=["conv_id", "alone"])

    # where a conversation of several blocks is alone for the first time
    alone = batches(blocks.filter(F.col("n") >= BLOCK), firsts, "conv_id long, alone long").groupBy("conv_id").agg(F.min("alone").alias("alone"))
    blocks = blocks.join(alone, "conv_id", "left")

    def screened(tails: bool):
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = _prefixes(batch)
            none = np.iinfo(np.int64).max
            first = np.full(len(p["begins"]), none)
            np.minimum.at(first, p["row"], np.where(_single(p, bits.value, power), p["depth"], none))
            known = batch.column("alone").to_pandas().to_numpy(float, na_value=np.nan)
            first = np.where(np.isnan(known), first, np.nan_to_num(known).astype(np.int64))[p["row"]]
            conv, n = batch.column("conv_id").to_numpy()[p["row"]], batch.column("n").to_numpy()[p["row"]]
            if tails:
                at = p["depth"] > first
                c, d, n = conv[at], p["depth"][at], n[at]
                one, zero = np.ones(len(c), np.int64), np.zeros(len(c), np.int64)
                cells = [c, d, c, one, (d < n).astype(np.int64), one, zero, n]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=[f.split()[0] for f in NODE.split(", ")])
            at = p["depth"] <= first
            head = (p["depth"] == first)[at]
            cells = [conv[at], p["depth"][at], p["a"][at].view(np.int64), p["b"][at].view(np.int64), p["chars"][at], n[at], head]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["conv_id", "depth", "a", "b", "chars", "n", "head"])

        return make

    shared = staged(batches(blocks, screened(False), "conv_id long, depth long, a long, b long, chars long, n long, head boolean"), "screened")
    heads = shared.filter("head").withColumns({"top": F.col("conv_id"), "size": F.lit(1).cast("long"), "longer": (F.col("n") > F.col("depth")).cast("long")})
    known = _with_members(shared.filter("not head")).unionByName(heads)
    mine = F.col("top") == F.col("conv_id")
    ends_here = (F.col("depth") == F.col("n")) & (F.col("longer") == 0)
    known = known.select(
        "conv_id", "depth", "n", "head", "top",
        F.floor(F.col("depth") / BLOCK).alias("block"),
        F.when(mine, (F.col("size") - 1) * F.col("chars")).otherwise(0).cast("long").alias("saves"),
        (F.col("head") | (mine & ends_here)).cast("long").alias("leaf"),
    )
    known = staged(known, "known-prefixes")
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = (
        known.filter(F.col("n") >= BLOCK)
        .groupBy("conv_id", "block")
        .agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
        .select("conv_id", "block", F.sum("saves").over(later).alias("_saves"), F.sum("leaf").over(later).alias("_leaf"))
    )
    # the last turn of a block is also shown to the next block, whose first turn asks for its parent
    homes = F.when((F.col("depth") + 1) % BLOCK == 0, F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array("block"))
    shown = known.withColumn("_home", F.explode(homes))
    along = Window.partitionBy("conv_id", "_home").orderBy("depth")
    rest = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    walked = (
        shown.withColumns({"parent": F.lag("top").over(along), "_s": F.sum("saves").over(rest), "_l": F.sum("leaf").over(rest)})
        .filter(F.col("_home") == F.col("block"))
        .join(beyond, ["conv_id", "block"], "left")
    )
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def gives(node: Column, depth: Column, parent: Column, convs: Column, kids: Column, leaves: Column, saved: Column) -> Column:
        return F.struct(node.alias("conv_id"), depth.alias("depth"), parent.alias("parent_conv_id"), convs.alias("n_convs"), kids.alias("n_children"), leaves.alias("n_leaves"), saved.alias("saved_tokens"))

    leaves = F.col("_l") + F.coalesce(F.col("_leaf"), zero)
    saved = F.col("_s") + F.coalesce(F.col("_saves"), zero)
    tail = (F.col("head") & (F.col("n") > F.col("depth"))).cast("long")
    to_self = gives(F.col("top"), F.col("depth"), F.when(mine, F.col("parent")), one, tail, leaves, saved)
    to_parent = gives(F.col("parent"), F.col("depth") - 1, F.lit(None).cast("long"), zero, one, zero, zero)
    both = F.when(mine & (F.col("depth") > 0), F.array(to_self, to_parent)).otherwise(F.array(to_self))
    nodes = (
        walked.select(F.inline(both))
        .groupBy("conv_id", "depth")
        .agg(F.max("parent_conv_id").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    )
    ends = known.filter("depth = n").select(F.col("top").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    nodes = nodes.join(_end_digests(ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", _empty()))
    tails = batches(blocks, screened(True), NODE)
    tails = tails.withColumn("ends_sha256", F.when(F.col("depth") == F.col("n"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_empty())).drop("n")
    return nodes.unionByName(tails)


ORACLE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS own FROM turns GROUP BY conv_id),
crc AS (
  SELECT conv_id, own, xor(list_reduce(
    list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
      lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295::BIGINT), 4294967295) % 6 AS h
  FROM sizes),
convs AS (
  SELECT c.conv_id, c.h, c.conv_id - c.conv_id % 100 AS base, least(c.h, coalesce(b.own, 0)) AS lent
  FROM crc c LEFT JOIN sizes b ON b.conv_id = c.conv_id - c.conv_id % 100),
rebuilt AS (
  SELECT c.conv_id, pos + 1 AS d, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND pos < lent
  UNION ALL
  SELECT c.conv_id, lent + pos - h + 1, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos >= h),
paths AS (
  SELECT conv_id, d, length(text) AS chars, list(sha256(length(role)::VARCHAR || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
whole AS (SELECT conv_id, max(d) AS n FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saves,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends_sha256
  FROM paths JOIN whole USING (conv_id) GROUP BY path, d),
kids AS (SELECT p.path, count(k.path) AS n_children FROM nodes p LEFT JOIN nodes k ON k.depth = p.depth + 1 AND k.path[1 : p.depth] = p.path GROUP BY p.path),
below AS (
  SELECT u.path, sum(v.saves)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
  FROM nodes u JOIN nodes v ON v.depth >= u.depth AND v.path[1 : u.depth] = u.path JOIN kids k ON k.path = v.path GROUP BY u.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN kids k ON k.path = n.path JOIN below b ON b.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1 : n.depth - 1]
"""
