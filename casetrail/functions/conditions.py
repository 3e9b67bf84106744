"""Conditions on context fields as data.

A condition is a row (field, operator, expected value), not a piece of the plan: ``expected`` turns a literal into a
struct, ``facts`` turns a context into a map of its values in the same form, and one expression compares both, however
many templates, decisions and rules there are.  The equalities are those of ``values.rule_equal`` and
``values.loose_equal``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casetrail.functions import values as V

EXPECTED = "kind:string,text:string,json:string,num:double,flag:boolean,truth:boolean,yes:boolean,items:array<struct<kind:string,json:string>>"
RULES = f"array<struct<pos:int,is_else:boolean,field:string,op:string,want:struct<{EXPECTED}>>>"
CONDITIONS = f"array<struct<field:string,want:struct<{EXPECTED}>>>"

_YES = {"true": True, "1": True, "false": False, "0": False}


def _kind(value) -> str:
    """As ``values.value_type`` names it."""
    kind = V._literal_kind(value)
    return kind if kind != "number" else "float" if isinstance(value, float) else "int"


def expected(value) -> tuple:
    """A literal of a template as a row of EXPECTED."""
    kind = V._literal_kind(value)
    number = float(value) if kind == "number" or (kind == "string" and V._is_numeric_text(value)) else None
    text = value if kind == "string" else V._number_text(value) if kind == "number" else None
    if kind == "bool":
        yes = value
    elif kind == "number":
        yes = {0: False, 1: True}.get(value) if isinstance(value, int) else None
    else:
        yes = _YES.get(value.strip().lower()) if kind == "string" else None
    items = [(_kind(x), V.canonical(x)) for x in value] if isinstance(value, (list, tuple)) else None
    return kind, text, V.canonical(value), number, bool(value) and value != "0", bool(value), yes, items


def conditions(when: dict) -> list[tuple]:
    return [(name, expected(value)) for name, value in when.items()]


def rules(decision: dict) -> list[tuple]:
    """The rules of a decision in order, as rows of RULES."""
    out = []
    for pos, r in enumerate(decision["rules"]):
        field, op, value = r["when"] or (None, None, None)
        out.append((pos, r["else"], field, op, expected(value)))
    return out


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fact(v: Column) -> Column:
    def of(raw: Column) -> Column:
        kind, text = raw["kind"], raw["text"]
        low, whole = F.lower(V.trimmed(text)), kind.isin("int", "string")
        yes = (
            F.when(kind == "bool", text == "true")
            .when(whole & (low == "1"), F.lit(True))
            .when(whole & (low == "0"), F.lit(False))
            .when((kind == "string") & (low == "true"), F.lit(True))
            .when((kind == "string") & (low == "false"), F.lit(False))
        )
        number = F.when(kind.isin("int", "float"), raw["num"]).when(kind == "string", V._num(text))
        flag = (
            F.when(kind.isin("int", "float"), raw["num"] != 0)
            .when(kind == "bool", text == "true")
            .otherwise(~raw["json"].isin("null", '""', '"0"', "[]", "{}"))
        )
        return F.struct(kind.alias("kind"), text.alias("text"), raw["json"].alias("json"), number.alias("num"), flag.alias("flag"), yes.alias("yes"))

    kind = let(F.schema_of_variant(v), V.kind_of)
    number = F.try_variant_get(v, "$", "double")
    return let(F.struct(kind.alias("kind"), V.plain_text(v).alias("text"), V.value_text(v).alias("json"), number.alias("num")), of)


def facts(obj: Column, names: Column | None = None) -> Column:
    """Map of the fields of a context (of ``names`` only, where given) to their values; null without a context."""
    fields = F.try_variant_get(obj, "$", "map<string,variant>")
    if names is not None:
        fields = F.map_filter(fields, lambda k, _: F.array_contains(names, k))
    return F.transform_values(fields, lambda _, v: _fact(v))


def fact_of(facts: Column, name: Column) -> Column:
    return F.try_element_at(facts, name)


def filled(fact: Column) -> Column:
    """Present and neither null, empty text nor an empty list."""
    return fact.isNotNull() & ~F.coalesce(fact["json"], F.lit("null")).isin("null", '""', "[]", "{}")


def rule_equal(fact: Column, want: Column) -> Column:
    kind, plain = fact["kind"], fact["kind"].isin("int", "float", "string")
    text = F.when(kind == "string", F.coalesce(fact["num"] == want["num"], fact["text"] == want["text"])).otherwise(fact["num"] == want["num"])
    out = (
        F.when((want["kind"] == "bool") | ((kind == "bool") & (want["kind"] != "null")), fact["flag"] == want["flag"])
        .when(want["kind"] == "null", F.when(kind == "string", fact["text"] == "").otherwise(~fact["flag"]))
        .when(want["kind"] == "array", (kind == "array") & (fact["json"] == want["json"]))
        .when(want["num"].isNotNull(), plain & text)
        .otherwise(plain & (fact["text"] == want["text"]))
    )
    return F.coalesce(out, F.lit(False))


def loose_equal(fact: Column, want: Column) -> Column:
    plain = fact["kind"].isin("int", "float", "string")
    same = F.coalesce(fact["num"] == want["num"], fact["text"] == want["text"])
    out = (
        F.when(want["kind"].isin("null", "array"), (fact["kind"] == want["kind"]) & (fact["json"] == want["json"]))
        .when(want["yes"].isNotNull(), fact["yes"] == want["yes"])
        .otherwise(fact["yes"].isNull() & plain & same)
    )
    return F.coalesce(out, F.lit(False))


def rule_holds(fact: Column, rule: Column) -> Column:
    """One rule (an element of RULES) about the value of its field, never null."""
    want, op = rule["want"], rule["op"]
    exists = F.coalesce(fact["json"] != "null", F.lit(False))
    number = F.when(want["kind"].isin("number", "string"), want["num"])
    found = F.array_contains(want["items"], F.struct(fact["kind"].alias("kind"), fact["json"].alias("json")))
    out = (
        F.when(op == "exists", exists == want["truth"])
        .when(~exists, F.lit(False))
        .when(op == "eq", rule_equal(fact, want))
        .when(op == "neq", ~rule_equal(fact, want))
        .when(op == "in", found)
        .when(op == "gt", fact["num"] > number)
        .when(op == "gte", fact["num"] >= number)
        .when(op == "lt", fact["num"] < number)
        .when(op == "lte", fact["num"] <= number)
    )
    return F.coalesce(out, F.lit(False))


def first_rule(facts: Column, rules: Column) -> Column:
    """Position of the first rule that holds, else of the first ``else``."""

    def of(known: Column) -> Column:
        held = F.filter(rules, lambda r: ~r["is_else"] & r["op"].isNotNull() & let(fact_of(known, r["field"]), lambda f: rule_holds(f, r)))
        return F.get(held, F.lit(0))["pos"]

    fallback = F.filter(rules, lambda r: r["is_else"])
    return F.coalesce(let(facts, of), F.get(fallback, F.lit(0))["pos"])


def all_hold(facts: Column, conditions: Column) -> Column:
    """All conditions (elements of CONDITIONS) by loose equality; absent fields never are equal."""

    def of(known: Column) -> Column:
        return F.forall(conditions, lambda c: let(fact_of(known, c["field"]), lambda f: f.isNotNull() & loose_equal(f, c["want"])))

    return F.coalesce(let(facts, of), F.lit(False))


def missing(facts: Column, names: Column) -> Column:
    """Those of ``names`` that carry no value."""
    none = F.array().cast("array<string>")
    return F.coalesce(let(facts, lambda known: F.filter(names, lambda n: ~let(fact_of(known, n), filled))), none)
