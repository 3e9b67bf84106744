"""Column builders for values held in a JSON context.

A context is a JSON object kept as STRING at rest.  At use it becomes a
VARIANT, so a value keeps its JSON type (``1`` and ``"1"`` stay different).
Everything here returns a Column; nothing runs per row in Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

NUMERIC_TEXT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def trimmed(text: Column | str) -> Column:
    """Without blanks, tabs, line ends, NUL and vertical tabs at either end."""
    return F.btrim(text, F.lit(" \t\n\r\0\x0b"))


def path(name: str) -> str:
    return '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def as_object(context: Column) -> Column:
    """VARIANT of a JSON object; null when the text is null, invalid or no object."""
    return F.when(trimmed(context).startswith("{"), F.try_parse_json(context))


def field(obj: Column, name: str) -> Column:
    """The field as VARIANT: SQL null if absent, variant null if JSON null."""
    return F.try_variant_get(obj, path(name), "variant")


def has_key(obj: Column, name: str) -> Column:
    return field(obj, name).isNotNull()


def value_text(v: Column) -> Column:
    """Canonical JSON text (object keys sorted); SQL null only when absent."""
    return F.to_json(v)


def plain_text(v: Column) -> Column:
    """Text of a scalar without quotes; JSON text for arrays and objects."""
    return F.try_variant_get(v, "$", "string")


def value_type(v: Column) -> Column:
    """null | bool | int | float | string | array  (objects count as array)."""
    return kind_of(F.schema_of_variant(v))


def kind_of(s: Column) -> Column:
    """``value_type`` of a variant's schema text."""
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s == "VOID", F.lit("null"))
        .when(s == "STRING", F.lit("string"))
        .when(s == "BOOLEAN", F.lit("bool"))
        .when(s == "BIGINT", F.lit("int"))
        .when(s.startswith("ARRAY") | s.startswith("OBJECT"), F.lit("array"))
        .otherwise(F.lit("float"))
    )


def is_filled(v: Column) -> Column:
    """Present and neither null, empty text nor an empty list."""
    return v.isNotNull() & ~F.coalesce(value_text(v), F.lit("null")).isin("null", '""', "[]", "{}")


def all_filled(obj: Column, names: list[str]) -> Column:
    ok = obj.isNotNull()
    for n in names:
        ok = ok & is_filled(field(obj, n))
    return F.coalesce(ok, F.lit(False))


def missing_names(obj: Column, names: list[str]) -> Column:
    """ARRAY<STRING> of the listed fields that carry no value."""
    if not names:
        return F.array().cast("array<string>")
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(is_filled(field(obj, n)), F.lit(False)), F.lit(n)) for n in names])
    )


def explode_fields(df: DataFrame, obj: str) -> DataFrame:
    """Long form: one row per top-level field, with ``field``, ``value_json`` and
    ``value_type``.  ``obj`` names a VARIANT column holding an object."""
    out = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(obj).outer()))
    return out.select(
        *[c for c in df.columns if c != obj],
        F.col("key").alias("field"),
        value_text(F.col("value")).alias("value_json"),
        value_type(F.col("value")).alias("value_type"),
    )


def _num(text: Column) -> Column:
    return F.when(text.rlike(NUMERIC_TEXT), trimmed(text).try_cast("double"))


def _literal_kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array"


def _is_numeric_text(text: str) -> bool:
    import re

    return re.match(NUMERIC_TEXT, text) is not None


def _number_text(value) -> str:
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def canonical(value) -> str:
    """Same text as ``value_text`` gives for this literal."""
    if isinstance(value, float) and value == int(value):
        value = int(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def truthy(v: Column) -> Column:
    """False for null, false, 0, '', '0' and []; true for everything else, 'false' included."""
    num = F.try_variant_get(v, "$", "double")
    kind = value_type(v)
    return (
        F.when(kind.isin("int", "float"), num != 0)
        .when(kind == "bool", F.try_variant_get(v, "$", "boolean"))
        .otherwise(~value_text(v).isin("null", '""', '"0"', "[]", "{}"))
    )


def rule_equal(v: Column, expected) -> Column:
    """Equality of decision rules.

    A boolean on either side compares truthiness; numbers and numeric texts
    compare as doubles; a number against other text, and text against text,
    compare as text.  Absent or null never equals anything but null itself.
    """
    kind, text = value_type(v), plain_text(v)
    want = _literal_kind(expected)
    if want == "bool":
        out = truthy(v) == F.lit(expected)
    elif want == "null":
        out = F.when(kind == "string", text == "").otherwise(~truthy(v))
    elif want == "array":
        out = F.when(kind == "bool", truthy(v) == F.lit(bool(expected))).otherwise(
            (kind == "array") & (value_text(v) == F.lit(canonical(expected)))
        )
    else:
        as_bool = F.when(kind == "bool", truthy(v) == F.lit(bool(expected) and expected != "0"))
        if want == "number":
            out = (
                as_bool.when(kind.isin("int", "float"), F.try_variant_get(v, "$", "double") == float(expected))
                .when(kind == "string", F.coalesce(_num(text) == float(expected), text == _number_text(expected)))
                .otherwise(F.lit(False))
            )
        elif _is_numeric_text(expected):
            out = (
                as_bool.when(kind.isin("int", "float"), F.try_variant_get(v, "$", "double") == float(expected))
                .when(kind == "string", F.coalesce(_num(text) == float(expected), text == expected))
                .otherwise(F.lit(False))
            )
        else:
            out = as_bool.when(kind.isin("int", "float", "string"), text == F.lit(expected)).otherwise(F.lit(False))
    return F.coalesce(out, F.lit(False))


def loose_equal(v: Column, expected) -> Column:
    """Equality of routing and journey conditions.

    Identical values are equal.  Otherwise null and lists equal nothing; if
    either side reads as a boolean (true/false/1/0, also as text) both must be
    the same boolean; numbers compare as doubles; the rest compares as text.
    """
    kind, text = value_type(v), plain_text(v)
    want = _literal_kind(expected)
    if want in ("null", "array"):
        same_kind = "null" if want == "null" else "array"
        return F.coalesce((kind == same_kind) & (value_text(v) == F.lit(canonical(expected))), F.lit(False))

    low = F.lower(trimmed(text))
    as_bool = (
        F.when(kind == "bool", F.try_variant_get(v, "$", "boolean"))
        .when((kind == "int") & (text == "1"), F.lit(True))
        .when((kind == "int") & (text == "0"), F.lit(False))
        .when((kind == "string") & low.isin("true", "1"), F.lit(True))
        .when((kind == "string") & low.isin("false", "0"), F.lit(False))
    )
    if want == "bool":
        exp_bool = expected
    elif isinstance(expected, int):
        exp_bool = {0: False, 1: True}.get(expected)
    elif isinstance(expected, str):
        exp_bool = {"true": True, "1": True, "false": False, "0": False}.get(expected.strip().lower())
    else:
        exp_bool = None
    if exp_bool is not None:
        out = as_bool == F.lit(exp_bool)
    else:
        num = F.when(kind.isin("int", "float"), F.try_variant_get(v, "$", "double")).when(kind == "string", _num(text))
        exp_text = expected if isinstance(expected, str) else _number_text(expected)
        same_text = text == F.lit(exp_text)
        if want == "number" or _is_numeric_text(expected):
            same = F.coalesce(num == float(expected), same_text)
        else:
            same = same_text
        out = F.when(as_bool.isNull() & kind.isin("int", "float", "string"), same).otherwise(F.lit(False))
    return F.coalesce(out, F.lit(False))


def all_loose_equal(obj: Column, when: dict) -> Column:
    ok = F.lit(True)
    for name, expected in when.items():
        v = field(obj, name)
        ok = ok & v.isNotNull() & loose_equal(v, expected)
    return F.coalesce(ok, F.lit(False))


def rule_condition(obj: Column, name: str, op: str, expected) -> Column:
    """One condition of a decision rule as a boolean Column (never null)."""
    v = field(obj, name)
    exists = F.coalesce(value_text(v) != "null", F.lit(False))
    if op == "exists":
        return exists == F.lit(bool(expected))
    if op == "eq":
        return exists & rule_equal(v, expected)
    if op == "neq":
        return exists & ~rule_equal(v, expected)
    if op == "in":
        if not isinstance(expected, (list, tuple)):
            return F.lit(False)
        kind, text = value_type(v), value_text(v)
        hit = F.lit(False)
        for item in expected:
            k = _literal_kind(item)
            if k == "number":
                k = "float" if isinstance(item, float) else "int"
            hit = hit | ((kind == k) & (text == canonical(item)))
        return exists & F.coalesce(hit, F.lit(False))
    if op in ("gt", "gte", "lt", "lte"):
        if _literal_kind(expected) not in ("number", "string") or (
            isinstance(expected, str) and not _is_numeric_text(expected)
        ):
            return F.lit(False)
        kind = value_type(v)
        num = F.when(kind.isin("int", "float"), F.try_variant_get(v, "$", "double")).when(
            kind == "string", _num(plain_text(v))
        )
        bound = float(expected)
        cmp = {"gt": num > bound, "gte": num >= bound, "lt": num < bound, "lte": num <= bound}[op]
        return exists & F.coalesce(cmp, F.lit(False))
    raise ValueError(f"unknown rule operator {op!r}")
