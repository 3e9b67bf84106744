"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a random key from a hash of its id. Inside a source, documents stand in order of that key (ranges
of the key, each sorted by itself), sums of words up to each document are added over ranges, and the source is cut
at its exact budget: whole epochs first, then documents up to the cut, the last of them in part.

Sources in code-point order, null last, weigh WEIGHTS in turn and share SHARE of all words; none gets more than
EPOCHS times its own words, and what is over goes to the others by weight. The level at which weights are filled is
the largest (budget - caps of the first m) / (weights of the others) over sources ordered by cap per weight.

Defined cases: a null text has no words; a null source is a source of its own, last; documents without words are never
taken; equal rows may change places, which leaves the result the same; an empty table gives no rows; further columns are
ignored by ``mix`` and kept by ``mixed_corpus``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casetrail.llm.common import ranked_total, running_total, spread, staged, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
WORD = r"[^\x20\x09-\x0D]+"
#: The table of sources is broadcast up to this many rows and characters of names, and joined by salted keys beyond.
SMALL_ROWS, SMALL_CHARS = 10_000, 1_000_000
SALTS = 64

KEYS = ["_none", "_source"]


def sized(docs: DataFrame) -> DataFrame:
    """Adds size, the keys of the source and the random key of the document."""
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 10), 16, 10)
    return docs.withColumns(
        {
            "_size": F.regexp_count(text_of(), F.lit(WORD)).cast("long"),
            "_none": F.col("source").isNull(),
            "_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "_u": u.cast("long"),
        }
    )


def budgets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per source: _n documents, _words, _target, and the words to take (_take)."""
    sources = sizes.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"), F.lit(1).alias("_one"))
    ranked = ranked_total(sources, KEYS, {"_rank": "_one"}, "mix-sources").drop("_one")
    turn = F.col("_rank") % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    cap = (EPOCHS * F.col("_words")).alias("_cap")
    capped = ranked.select(*KEYS, "_n", "_words", cap, weight.cast("long").alias("_weight"))
    capped = capped.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    filled = staged(ranked_total(capped, ["_ratio", *KEYS], {"_caps": "_cap", "_weights": "_weight"}, "mix-caps"), "mix-filled")
    words, everything = filled.agg(F.coalesce(F.sum("_words"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    filling = (F.lit(share * words) - F.col("_caps")) / (F.lit(everything) - F.col("_weights"))
    level = filled.agg(F.max(filling)).first()[0] or 0.0
    target = F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_weight"))
    out = filled.select(*KEYS, "_n", "_words", target.alias("_target"))
    return out.withColumn("_take", F.floor(F.col("_target") + 0.5).cast("long"))


def _with_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    n, chars = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_source")), F.lit(0))).first()
    if n <= SMALL_ROWS and chars <= SMALL_CHARS:
        return df.join(F.broadcast(sources), KEYS)
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod("_u", F.lit(SALTS)).cast("int")).join(salted, [*KEYS, "_salt"]).drop("_salt")


def _taken() -> Column:
    epochs = F.when(F.col("_words") > 0, F.expr("_take div _words")).otherwise(F.lit(0))
    rest = F.col("_take") - epochs * F.col("_words")
    part = F.greatest(F.least(rest - F.col("_before"), F.col("_size")), F.lit(0))
    return (epochs * F.col("_size") + part).cast("long")


def _mix(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    rows = _with_source(sizes, sources).withColumn("_parts", spread(F.col("_n")))
    return running_total(rows, KEYS, "_u", "_parts", "_size", ["doc_id", "_size"], "_before").withColumn("_taken", _taken())


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken (words that the mix takes, repeats counted)."""
    sizes = staged(sized(docs).select("doc_id", "_size", *KEYS, "_u"), "mix-sizes")
    sources = staged(budgets(sizes), "mix-budgets")
    return _mix(sizes, sources).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_words").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )


def mixed_corpus(docs: DataFrame) -> DataFrame:
    """The mix itself: whole documents as often as taken; one cut by a budget ends with the words taken, one blank apart."""
    rest_of = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))
    rows = sized(rows)
    sources = staged(budgets(rows.select("_size", *KEYS)), "mix-budgets")
    mixed = _mix(rows, sources).filter("_taken > 0")
    whole, rest = F.expr("_taken div _size"), F.expr("_taken % _size").cast("int")
    copies = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), (whole + (rest > 0).cast("int")).cast("int"))))
    words = F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))
    cut = F.col("_copy") > whole
    text = F.when(cut, F.array_join(F.slice(words, 1, F.greatest(rest, F.lit(1))), " ")).otherwise(F.col("text")).alias("text")
    made = {c: F.col("_row")[c].alias(c) for c in rest_of} | {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(cut, F.length(text).cast("long")).otherwise(F.col("_row")["n_chars"]).alias("n_chars")
    return copies.select(*[made[c] for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substring(md5(coalesce(doc_id::VARCHAR, '')), 1, 10) AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS words, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, coalesce(sum(2 * words) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS weights
  FROM s WINDOW o AS (ORDER BY (2 * words) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max(((SELECT 1.5::DOUBLE * sum(words)::DOUBLE FROM s) - caps::DOUBLE) / ((SELECT sum(weight) FROM s) - weights)::DOUBLE) AS level FROM c
), t AS (
  SELECT source, words, least((2 * words)::DOUBLE, level * weight::DOUBLE) AS target FROM c, l
), b AS (
  SELECT *, floor(target + 0.5)::BIGINT AS take FROM t
), r AS (
  SELECT d.*, b.words, b.target, b.take, CASE WHEN b.words > 0 THEN b.take // b.words ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, words AS source_size, target,
       (epochs * size + greatest(least(take - epochs * words - before, size), 0))::BIGINT AS taken
FROM r
"""
