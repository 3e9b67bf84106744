"""Tagged documents into export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casetrail.functions.values import trimmed
from casetrail.operators.cases import hot_keys
from casetrail.operators.numbering import numbered


def dedup_documents(documents: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """First row per id with the number of copies; rows without id are all kept.

    Copies meet in a partial aggregation, so a much-copied id is no hot spot."""
    blank = F.col(key).isNull() | (F.col(key).cast("string") == "")
    cols = documents.columns
    kept = documents.filter(blank).withColumn("copies", F.lit(1).cast("long"))
    first = (
        documents.filter(~blank)
        .groupBy(key)
        .agg(F.min_by(F.struct(*[c for c in cols if c != key]), F.col(order)).alias("_d"), F.count(F.lit(1)).alias("copies"))
        .select(key, "_d.*", "copies")
    )
    return kept.unionByName(first)


def document_matrix(tags: DataFrame, fields: dict[str, str], nodes: DataFrame) -> DataFrame:
    """One row per document, one column per mapped field (first value).

    ``tags``: doc_id, tag_pos, definition_id, tag_type, value, node_id;
    ``fields``: column name -> definition id.  Selections give their node's
    value, numbers stay scaled as they are stored."""
    names = {d: f for f, d in fields.items()}
    used = tags.filter(F.col("definition_id").isin(*names)).join(nodes, "node_id", "left")
    value = F.when(F.col("tag_type") == "selections", F.col("node_value")).otherwise(F.col("value"))
    label = F.lit(None).cast("string")
    for d, f in names.items():
        label = F.when(F.col("definition_id") == d, F.lit(f)).otherwise(label)
    rows = used.select("doc_id", "tag_pos", label.alias("_f"), value.alias("_v"))
    return rows.groupBy("doc_id").pivot("_f", list(fields)).agg(F.min_by("_v", "tag_pos"))


def expand_split_rows(tags: DataFrame) -> DataFrame:
    """Repeated tags become one row per tag group; single tags go to every row.

    ``tags``: doc_id, tag_pos, definition_id, group_definition, group_id, value.
    Returns long form: doc_id, row_no, definition_id, value."""
    tags = tags.filter(F.col("doc_id").isNotNull() & F.col("definition_id").isNotNull())
    tags = tags.withColumns({c: F.coalesce(c, F.lit("")) for c in ("group_definition", "group_id")})  # no group is one group
    large = hot_keys(tags, ["doc_id"])
    if large is None:
        return _split_in_place(tags)
    large = F.broadcast(large.select("doc_id"))
    few, many = tags.join(large, "doc_id", "left_anti"), tags.join(large, "doc_id", "left_semi")
    return _split_in_place(few).unionByName(_split_large(many))


def _split_in_place(tags: DataFrame) -> DataFrame:
    """``expand_split_rows`` in the one shuffle that brings the tags of a document together."""
    doc = Window.partitionBy("doc_id")
    t = tags.repartition("doc_id").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "definition_id")))
    many = F.col("_n") > 1
    at = F.min(F.when(many, F.col("tag_pos"))).over(Window.partitionBy("doc_id", "group_definition", "group_id", many))
    t = t.withColumn("_at", at)
    nth = F.dense_rank().over(Window.partitionBy("doc_id", "group_definition", many).orderBy("_at", "group_id"))
    t = t.withColumn("_rank", F.when(many, nth))
    t = t.withColumn("_rows", F.max("_rank").over(doc))
    last = F.coalesce("_rows", F.lit(1)) - 1
    places = F.when(many, F.array(F.col("_rank") - 1)).otherwise(F.sequence(F.lit(0), last))
    rows = t.select("doc_id", F.explode(places).alias("row_no"), "definition_id", "tag_pos", "value", "_n")
    return rows.groupBy("doc_id", "row_no", "definition_id").agg(F.when(F.max("_n") > 1, F.max_by("value", "tag_pos")).otherwise(F.max("value")).alias("value"))


def _split_large(tags: DataFrame) -> DataFrame:
    """``expand_split_rows`` for documents that no task should hold."""
    n = tags.groupBy("doc_id", "definition_id").agg(F.count(F.lit(1)).alias("_n"))
    t = tags.join(n, ["doc_id", "definition_id"])
    many = t.filter(F.col("_n") > 1)
    groups = many.groupBy("doc_id", "group_definition", "group_id").agg(F.min("tag_pos").alias("_at"))
    ranked = numbered(groups, ["doc_id", "group_definition"], ["_at"], "_rank").drop("_at", "block")
    split = (
        many.join(ranked, ["doc_id", "group_definition", "group_id"])
        .groupBy("doc_id", (F.col("_rank") - 1).cast("int").alias("row_no"), "definition_id")
        .agg(F.max_by("value", "tag_pos").alias("value"))
    )
    size = ranked.groupBy("doc_id").agg(F.max("_rank").cast("int").alias("_rows"))
    single = (
        t.filter(F.col("_n") == 1)
        .join(size, "doc_id", "left")
        .select("doc_id", F.explode(F.sequence(F.lit(0), F.coalesce("_rows", F.lit(1)) - 1)).alias("row_no"), "definition_id", "value")
    )
    return split.unionByName(single)


def split_by_period(rows: DataFrame, period: Column) -> DataFrame:
    """Add ``period``, the folder an export row belongs to ('' when unknown)."""
    return rows.withColumn("period", F.coalesce(period, F.lit("")))


def net_of_tax(rows: DataFrame, rates: DataFrame, gross: str, code: str) -> DataFrame:
    """``net`` = gross / (1 + rate); rows with an unknown code keep the gross amount.

    ``rates``: tax_code, rate (percent)."""
    r = rates.withColumnRenamed("tax_code", code)
    net = F.round(F.col(gross) / (F.lit(1.0) + F.col("rate") / 100), 2)
    return rows.join(r, code, "left").withColumn("net", F.coalesce(net, F.col(gross))).drop("rate")


def map_by_doctype(rows: DataFrame, texts: DataFrame, doctype: str, default: Column) -> DataFrame:
    """``doctype_text`` from a table (doctype, text), else the default."""
    t = texts.select(F.col("doctype").alias(doctype), F.col("text").alias("_text"))
    return rows.join(t, doctype, "left").withColumn("doctype_text", F.coalesce("_text", default)).drop("_text")


def row_counter(rows: DataFrame, order: list[str], start: int = 1, name: str = "counter") -> DataFrame:
    """Running number in an explicit order; a large table is numbered range by range."""
    out = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], order, name)
    return out.withColumn(name, F.col(name) + (start - 1)).drop("_all", "block")


def calculated_column(rows: DataFrame, name: str, expression: str) -> DataFrame:
    """A column from a Spark SQL expression over the row."""
    return rows.withColumn(name, F.expr(expression))


def latest_change(rows: DataFrame, column: str = "changed_at") -> DataFrame:
    """Highest change time of a batch: the low bound of the next one."""
    return rows.agg(F.max(column).alias("latest_change"))


def extract_tag_values(tags: DataFrame, definition_id: str, nodes: DataFrame) -> DataFrame:
    """Non-blank values of one tag per document, selections resolved."""
    used = tags.filter(F.col("definition_id") == definition_id).join(nodes, "node_id", "left")
    value = F.when(F.col("tag_type") == "selections", F.col("node_value")).otherwise(F.col("value"))
    out = used.select("doc_id", F.col("tag_pos").alias("pos"), trimmed(value).alias("name"))
    return out.filter(F.col("name") != "")
