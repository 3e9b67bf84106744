"""Sign-off sets: who had to sign and who did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casetrail.functions import values as V
from casetrail.operators.conformance import KEY
from casetrail.plans.templates import TemplateSet, small_table


def _scalar_text(v: Column) -> Column:
    """One-element text list for a scalar, empty for null and lists."""
    kind, text = V.value_type(v), V.plain_text(v)
    text = F.when(kind == "bool", F.when(text == "true", F.lit("1"))).when(
        kind.isin("string", "int", "float"), text
    )
    return F.array_compact(F.array(text))


def _depth(v: Column) -> Column:
    """How deep lists and objects are nested."""
    marks = F.regexp_replace(F.regexp_replace(V.value_text(v), r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")

    def step(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(F.split(marks, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda x: x["most"])


def _members(v: Column) -> Column:
    """Texts inside a list or object: objects give their name, else their id,
    else their own members.

    Every round replaces nested values by what they hold, in place; as many
    rounds as the value is deep leave none."""
    plain = ("string", "int", "float", "bool")

    def held(e: Column) -> Column:
        return F.coalesce(F.try_variant_get(e, "$", "array<variant>"), F.map_values(F.try_variant_get(e, "$", "map<string,variant>")))

    def opened(e: Column) -> Column:
        name, ident = V.field(e, "name"), V.field(e, "id")
        return (
            F.when(V.value_type(name).isin(*plain), F.array(name))
            .when(V.value_type(ident).isin(*plain), F.array(ident))
            .when(V.value_type(e) == "array", held(e))
            .otherwise(F.array(e))
        )

    rounds = F.sequence(F.lit(1), F.greatest(_depth(v), F.lit(1)))
    leaves = F.aggregate(rounds, held(v), lambda items, _: F.flatten(F.transform(items, opened)))
    return F.coalesce(F.flatten(F.transform(leaves, _scalar_text)), F.array().cast("array<string>"))


def name_set(v: Column) -> Column:
    """Distinct trimmed names of a list, of JSON text, or of text split at , ; or line ends."""
    kind, text = V.value_type(v), V.plain_text(v)
    decoded = F.when(kind == "string", F.try_parse_json(text))
    names = (
        F.when(kind == "array", _members(v))
        .when(V.value_type(decoded) == "array", _members(decoded))
        .when(kind == "string", F.split(text, "[,;\n]+"))
        .when(kind.isin("int", "float", "bool"), _scalar_text(v))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_distinct(F.filter(F.transform(names, V.trimmed), lambda n: n != ""))


def sign_checks(entries: DataFrame, templates: TemplateSet) -> DataFrame:
    """One row per case and sign check, judged on the latest entry that has either set."""
    checks = small_table(
        templates.spark,
        [(t.key, s["key"], s["label"], s["required"], s["actual"]) for t in templates for s in t.sign_checks],
        "template_key string, check_key string, label string, required_field string, actual_field string",
    )

    def fields(context: Column) -> Column:
        return F.try_variant_get(V.as_object(context), "$", "map<string,variant>")

    tagged = templates.expand(entries).withColumn("_keys", F.map_keys(fields(F.col("sum_context")))).join(checks, "template_key")
    has = F.array_contains("_keys", F.col("required_field")) | F.array_contains("_keys", F.col("actual_field"))
    latest = tagged.groupBy(*KEY, *checks.columns[1:]).agg(F.max_by("sum_context", F.when(has, F.col("entry"))).alias("_context"))
    both = latest.withColumn("_fields", fields(F.col("_context"))).withColumns(
        {"_required": F.try_element_at("_fields", F.col("required_field")), "_actual": F.try_element_at("_fields", F.col("actual_field"))}
    )
    absent = [F.when(F.col(f"_{side}").isNull(), F.col(f"{side}_field")) for side in ("required", "actual")]
    d = both.select(
        *KEY,
        "check_key",
        "label",
        F.array_compact(F.array(*absent)).alias("missing_context"),
        name_set(F.col("_required")).alias("required"),
        name_set(F.col("_actual")).alias("actual"),
    )
    missing, extra = F.array_except("required", "actual"), F.array_except("actual", "required")
    matched = F.size("required") - F.size(missing)
    status = (
        F.when(F.size("missing_context") > 0, "missing_context")
        .when(F.size("required") == 0, "empty_required_set")
        .when((F.size(missing) == 0) & (F.size(extra) == 0), "satisfied")
        .when(F.size(missing) == 0, "unexpected_signer")
        .when(matched == 0, "missing_all")
        .otherwise("partial")
    )
    known = F.size("missing_context") == 0
    some = known & (F.size("required") > 0)
    none = F.array().cast("array<string>")
    return d.select(
        *KEY,
        "check_key",
        "label",
        status.alias("status"),
        F.when(known, F.size("required")).otherwise(0).alias("required_count"),
        F.when(known, F.size("actual")).otherwise(0).alias("actual_count"),
        F.when(some, matched).otherwise(0).alias("matched_count"),
        F.when(some, F.size(missing)).otherwise(0).alias("missing_count"),
        F.when(known, F.size(extra)).otherwise(0).alias("unexpected_count"),
        "missing_context",
        F.when(some, missing).otherwise(none).alias("missing_names"),
        F.when(some, extra).otherwise(none).alias("unexpected_names"),
    )


SIGN_OK = ["satisfied", "unexpected_signer"]


def signature_completeness(required: DataFrame, confirmed: DataFrame, doc: str = "doc_id", name: str = "name") -> DataFrame:
    """Long form: one row per document and distinct name with both presence flags.

    Names compare trimmed and without case; the first spelling (column ``pos``
    in its side) is shown.
    """

    def side(df: DataFrame, flag: str) -> DataFrame:
        clean = V.trimmed(F.col(name))
        return (
            df.filter(clean != "")
            .groupBy(doc, F.lower(clean).alias("name_key"))
            .agg(F.min_by(clean, F.col("pos")).alias(f"{flag}_name"))
            .withColumn(flag, F.lit(True))
        )

    both = side(required, "required").join(side(confirmed, "confirmed"), [doc, "name_key"], "full_outer")
    no = F.lit(False)
    return both.select(
        doc,
        "name_key",
        F.coalesce("required_name", "confirmed_name").alias("name"),
        F.coalesce("required", no).alias("required"),
        F.coalesce("confirmed", no).alias("confirmed"),
    )


def signature_report(completeness: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: counts, missing and unexpected names, complete or not, and a message."""
    counts = completeness.groupBy(doc).agg(
        F.count_if("required").alias("required_count"),
        F.count_if("confirmed").alias("confirmed_count"),
        F.count_if(F.col("required") & ~F.col("confirmed")).alias("missing_count"),
        F.count_if(~F.col("required") & F.col("confirmed")).alias("unexpected_count"),
        F.array_sort(F.collect_list(F.when(F.col("required") & ~F.col("confirmed"), F.col("name")))).alias("missing_names"),
        F.array_sort(F.collect_list(F.when(~F.col("required") & F.col("confirmed"), F.col("name")))).alias("unexpected_names"),
    )
    none = F.array().cast("array<string>")
    missing, extra = F.array_join("missing_names", ", "), F.array_join("unexpected_names", ", ")
    zero = {c: 0 for c in ("required_count", "confirmed_count", "missing_count", "unexpected_count")}
    complete = (F.col("missing_count") == 0) & (F.col("unexpected_count") == 0)
    return (
        documents.select(doc)
        .distinct()
        .join(counts, doc, "left")
        .fillna(zero)
        .withColumns({c: F.coalesce(c, none) for c in ("missing_names", "unexpected_names")})
        .withColumn("complete", complete)
        .withColumn("result", F.when(complete, F.lit("complete")).otherwise(F.lit("incomplete")))
        .withColumn(
            "message",
            F.when(complete, F.lit("All signatures are there."))
            .when(F.col("unexpected_count") == 0, F.concat(F.lit("Missing: "), missing))
            .when(F.col("missing_count") == 0, F.concat(F.lit("Unexpected: "), extra))
            .otherwise(F.concat(F.lit("Missing: "), missing, F.lit("; unexpected: "), extra)),
        )
    )


def signature_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if("complete").alias("complete_count"),
        F.count_if(~F.col("complete")).alias("incomplete_count"),
    )
