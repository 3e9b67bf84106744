"""Text, time and export formatting as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casetrail.functions.values import NUMERIC_TEXT, trimmed

DEFAULT_ZONE = "Europe/Berlin"

# Letter replacements of a normalised step name.
STEP_LETTERS = [("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalize_step(step: Column) -> Column:
    """Trimmed, blanks squeezed, umlauts spelled out, ASCII letters lowered."""
    out = F.regexp_replace(F.regexp_replace(step, r"^\s+|\s+$", ""), r"\s+", " ")
    for a, b in STEP_LETTERS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, _UPPER, _LOWER)


def parse_event_time(raw: Column, zone: str = DEFAULT_ZONE) -> Column:
    """UTC timestamp in whole seconds, null when unreadable.

    A ``+`` lost in form encoding is restored; text without an offset is read
    in ``zone``.  The session time zone must be UTC.
    """
    t = trimmed(raw)
    t = F.regexp_replace(t, r"(T\d{2}:\d{2}:\d{2})\s(\d{2}:\d{2})$", "$1+$2")
    t = F.regexp_replace(t, r"(T\d{2}:\d{2}:\d{2})\s([+-]\d{2}:\d{2})$", "$1$2")
    t = F.regexp_replace(t, r"(:\d{2}(?:\.\d+)?)([+-]\d{2})(\d{2})$", "$1$2:$3")
    zoned = t.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$") & t.contains(":")
    ts = F.when(zoned, t.try_cast("timestamp")).otherwise(
        F.to_utc_timestamp(t.try_cast("timestamp_ntz").cast("timestamp"), zone)
    )
    return F.date_trunc("second", ts)


def fmt_number(scaled: Column, decimals: int, separator: str = ",") -> Column:
    """Scaled number (x 10,000) with fixed decimals and no thousands mark."""
    value = F.round(scaled.cast("decimal(28,0)") / F.lit(10000).cast("decimal(5,0)"), decimals)
    text = value.cast(f"decimal(28,{decimals})").cast("string")
    return F.replace(text, F.lit("."), F.lit(separator)) if separator != "." else text


def fmt_date(ts: Column, pattern: str = "dd.MM.yyyy", zone: str = DEFAULT_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)


def fmt_first(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def fmt_slice(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start + 1, length)


def fmt_prefix(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text)


def fmt_no_blanks(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def _leading_number(text: Column) -> Column:
    """Number at the start of a text, 0 when there is none."""
    head = F.regexp_extract(text, r"^\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(head.try_cast("double"), F.lit(0.0))


def _loosely_equal(text: Column, operand: str) -> Column:
    """Numbers written as text compare as numbers, anything else as text."""
    both = text.rlike(NUMERIC_TEXT) & F.lit(operand).rlike(NUMERIC_TEXT)
    numbers = trimmed(text).try_cast("double") == trimmed(F.lit(operand)).try_cast("double")
    return F.when(both, numbers).otherwise(text == F.lit(operand))


def fmt_if(text: Column, branches: list[tuple[str, str, str]], default: str) -> Column:
    """First matching branch of (operator, operand, result).

    Operators: STARTSWITH, ENDSWITH, L, LE, G, GE, E.
    """
    out = None
    num = _leading_number(text)
    for op, operand, result in branches:
        bound = 0.0
        if op in ("L", "LE", "G", "GE"):
            bound = float(operand)
        cond = {
            "STARTSWITH": text.startswith(operand),
            "ENDSWITH": text.endswith(operand),
            "L": num < bound,
            "LE": num <= bound,
            "G": num > bound,
            "GE": num >= bound,
            "E": _loosely_equal(text, operand),
        }[op]
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def clean_export_text(text: Column, max_length: int | None = None) -> Column:
    """Line breaks and tabs to blanks, pipe to `` / ``, blanks squeezed, cut to length."""
    out = F.regexp_replace(text, r"\r\n|\r|\n|\t", " ")
    out = F.replace(out, F.lit("|"), F.lit(" / "))
    out = F.regexp_replace(trimmed(out), " {2,}", " ")
    if max_length is not None and max_length > 0:
        out = F.substring(out, 1, max_length)
    return out
