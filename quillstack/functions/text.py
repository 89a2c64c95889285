"""Text expressions. Lengths and slices count Unicode code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space that str.strip() removes.
SPACE_CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

EDGE_SPACE = rf"\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z"
NOT_SPACE = rf"[^{SPACE_CLASS}]"

#: Control characters used as internal marks; ``escape_marks`` takes them out of a text first.
OPEN_MARK = "\u0002"
CLOSE_MARK = "\u0003"
_ESCAPES = {"\u0004": "\u0004\u0007", OPEN_MARK: "\u0004\u0005", CLOSE_MARK: "\u0004\u0006"}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def escape_marks(text: Column) -> Column:
    """The text with each mark, and the escape sign itself, as two other control characters."""
    out = text
    for sign, pair in _ESCAPES.items():
        out = F.replace(out, F.lit(sign), F.lit(pair))
    return F.when(text.rlike("[\\x02-\\x04]"), out).otherwise(text)


def unescape_marks(text: Column) -> Column:
    """What ``escape_marks`` was given; the escape sign comes last, so no pair is made on the way."""
    out = text
    for sign, pair in reversed(_ESCAPES.items()):
        out = F.replace(out, F.lit(pair), F.lit(sign))
    return F.when(F.contains(text, F.lit("\u0004")), out).otherwise(text)


def has_content(text: Column) -> Column:
    """True when the text holds at least one character that is not white space."""
    return F.coalesce(text.rlike(NOT_SPACE), F.lit(False))


def regex_literal(text: str) -> str:
    """Escape ``text`` so that Java matches it literally."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\\1", text)


def replacement_literal(text: str) -> str:
    """Escape ``text`` for the replacement side of ``regexp_replace``."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty when the name has none."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)\z", 1))


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]+\z", "$1")


def estimate_tokens(text: Column) -> Column:
    """Four characters per token, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / F.lit(4)).cast("long")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def count_runs(text: Column, inside: str, outside: str) -> Column:
    """Number of runs of ``inside`` characters; ``outside`` is the opposite character class.

    Each run shrinks to one character, so nothing is collected into an array as ``regexp_count`` does.
    """
    runs = F.length(F.regexp_replace(text, f"{outside}*+{inside}++{outside}*+", "x"))
    return F.when(text.rlike(inside), runs).when(text.isNotNull(), F.lit(0))


def count_words(text: Column) -> Column:
    """Size of ``words`` without building it."""
    return count_runs(F.lower(text), r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]")


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))
