"""Shared fragments of the DuckDB counterparts."""

from __future__ import annotations

from quillstack.functions.text import EDGE_SPACE, NOT_SPACE
from quillstack.operators.chunk import separator_pattern


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {quote(EDGE_SPACE)}, '', 'g')"


def has_content(expr: str) -> str:
    return f"regexp_matches({expr}, {quote(NOT_SPACE)})"


def units(expr: str, separators) -> str:
    """Non-blank units of a text as a list."""
    marked = f"regexp_replace({expr}, {quote(separator_pattern(separators))}, '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda u: {has_content('u')})"


def windows(expr: str, size: int, overlap: int) -> str:
    """List of character windows."""
    step = max(size - overlap, 1)
    last = f"CAST(ceil(greatest(length({expr}) - {size}, 0) / {step}.0) AS BIGINT)"
    return f"list_transform(range(0, {last} + 1), lambda i: substring({expr}, 1 + {step} * i, {size}))"


def kept(expr: str) -> str:
    """Non-blank items without the white space at their ends."""
    return f"list_transform(list_filter({expr}, lambda k: {has_content('k')}), lambda k: {strip('k')})"


def explode(source: str, keys: str, items: str) -> str:
    """Rows (keys, index, chunk) of a list expression."""
    return f"""SELECT {keys}, unnest(range(0, len(l))) AS index, unnest(l) AS chunk
FROM (SELECT {keys}, {items} AS l FROM {source})"""


def words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}]+')"
