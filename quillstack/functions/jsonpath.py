"""Lenient JSON access: bad JSON, wrong types and missing fields give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_json(text: Column) -> Column:
    """Drop control characters that make stored JSON unreadable."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def json_field(text: Column, path: str) -> Column:
    """Text of a dotted field, or null."""
    return F.get_json_object(clean_json(text), "$." + path)


def json_long(text: Column, path: str) -> Column:
    """Integer value of a dotted field; anything that is not an integer gives null."""
    return F.try_variant_get(F.try_parse_json(clean_json(text)), "$." + path, "bigint")


# Short escapes of a JSON string, backslash first.
SHORT_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]


def python_json_string(text: Column) -> Column:
    """JSON string literal with every unit outside printable ASCII written as ``\\uXXXX``."""
    escaped = text
    for char, short in SHORT_ESCAPES:
        escaped = F.replace(escaped, F.lit(char), F.lit(short))
    printable = escaped.rlike(r"\A[\x20-\x7e]*\z")
    body = F.when(printable, escaped).otherwise(F.array_join(F.transform(F.split(escaped, ""), _ascii_unit), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def _ascii_unit(ch: Column) -> Column:
    code = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
    low = F.when(F.length(code) > 4, F.concat(F.lit("\\u"), F.substring(code, 5, 4))).otherwise(F.lit(""))
    return F.when(ch.rlike(r"\A[\x20-\x7e]?\z"), ch).otherwise(
        F.concat(F.lit("\\u"), F.substring(code, 1, 4), low)
    )
