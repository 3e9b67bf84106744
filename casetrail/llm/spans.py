"""Marked spans of a text: (kind, start, end), ends exclusive, counted in code points."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

Span = tuple[str, int, int]
TYPE = "array<struct<kind: string, start: int, end: int>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def ordered(spans: list[Span], kinds: list[str]) -> list[Span]:
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def as_arrow(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def joined(spans: Column | str) -> Column:
    """kind:start:end of a span column, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    """doc_id, a count per kind, base_sha256 and spans from the columns ``base`` and ``spans``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, kinds), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def free_of(spans: list[Span], start: int, end: int) -> bool:
    return all(end <= a or b <= start for _, a, b in spans)


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The covered stretches, in order."""
    out: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def masked(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for a, b in merged(spans):
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def sha(text: str) -> str:
    return sha256(text.encode()).hexdigest()
