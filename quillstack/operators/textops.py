"""Profiles and edits of text, CSV and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.functions.arrays import explode_items, let
from quillstack.functions.text import (
    NOT_SPACE, SPACE_CLASS, count_char, count_runs, regex_literal, replacement_literal,
)
from quillstack.functions.windows import salted_join

PREVIEW_CHARS = 500

# Names of secrets and the forms in which they are written.
SECRET_NAMES = r"api[_-]?key|access[_-]?token|token|password|secret|key"
SECRET_FORMS = [
    (rf"\b({SECRET_NAMES})=", r"[^&\s]"),
    (r"(authorization\s*[:=]\s*bearer\s+)", r"[^\s,;]"),
    (r"(x-goog-api-key\s*[:=]\s*)", r"[^\s,;]"),
    (r"(x-api-key\s*[:=]\s*)", r"[^\s,;]"),
]


def line_count(text: Column) -> Column:
    return count_char(text, "\n") + 1


def word_count(text: Column) -> Column:
    return count_runs(text, NOT_SPACE, f"[{SPACE_CLASS}]")


def preview(text: Column, size: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def text_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines, words, preview, and whether the text is long in lines or words."""
    t = F.col(text)
    return df.withColumn("lines", line_count(t)).withColumn("words", word_count(t)).withColumn("preview", preview(t)).withColumn(
        "many_lines", F.col("lines") > 100
    ).withColumn("many_words", F.col("words") > 1000)


def markdown_profile(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return df.withColumn("headers", F.regexp_count(t, F.lit(r"(?m)^#"))).withColumn(
        "code_blocks", F.floor(F.regexp_count(t, F.lit("```")) / 2)
    ).withColumn("lines", line_count(t))


def code_profile(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    out = df.withColumn("lines", line_count(t))
    for name in ("import", "from", "class", "def"):
        out = out.withColumn(f"n_{name}", F.regexp_count(t, F.lit(f"{name} ")))
    return out


def generic_preview(content: Column) -> Column:
    """First ten lines of UTF-8 bytes; other bytes are flagged."""
    text = F.try_validate_utf8(content.cast("string"))
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    first = F.array_join(F.transform(F.slice(lines, 1, 10), lambda x: F.regexp_replace(x, r"\s+\z", "")), "\n")
    shown = F.when(F.size(lines) >= 10, F.concat(first, F.lit("\n..."))).otherwise(first)
    return F.coalesce(shown, F.lit("[Binary or non-text file]"))


def json_kind(text: Column) -> Column:
    """object, array, string, number, boolean or null; null for text that is not JSON."""
    head = F.substring(F.ltrim(F.regexp_replace(text, r"\A\s+", "")), 1, 1)
    kind = (
        F.when(head == "{", F.lit("object")).when(head == "[", F.lit("array")).when(head == '"', F.lit("string"))
        .when(head.isin("t", "f"), F.lit("boolean")).when(head == "n", F.lit("null")).otherwise(F.lit("number"))
    )
    return F.when(F.try_parse_json(text).isNotNull(), kind)


def json_depth(text: Column) -> Column:
    """Nesting depth; empty containers add nothing. Strings are removed first, then brackets are counted."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"', "0")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s+", ""), r"\{\}|\[\]", "0")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.when(F.try_parse_json(text).isNotNull(), F.aggregate(marks, start, step)["most"])


def json_profile(df: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    kind = json_kind(t)
    return df.withColumn("kind", kind).withColumn(
        "keys", F.when(kind == "object", F.size(F.json_object_keys(t)))
    ).withColumn("items", F.when(kind == "array", F.json_array_length(t))).withColumn("depth", json_depth(t))


def csv_profile(df: DataFrame, preview_rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows, columns and size flags of a table, and its first rows by all columns."""
    facts = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns))).withColumn(
        "large", F.col("rows") > 1000
    ).withColumn("wide", F.col("columns") > 20)
    return facts, df.orderBy(*df.columns).limit(preview_rows)


def find_replace(
    text: Column, pattern: str, replacement: str, use_regex: bool = False, case_sensitive: bool = True
) -> tuple[Column, Column]:
    """New text and number of matches. In literal mode pattern and replacement are taken as written."""
    expression = pattern if use_regex else regex_literal(pattern)
    if not case_sensitive:
        expression = "(?iu)" + expression
    target = replacement if use_regex else replacement_literal(replacement)
    return F.regexp_replace(text, expression, target), F.regexp_count(text, F.lit(expression))


def _lines(text: Column) -> Column:
    """Lines with their line breaks."""
    return F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


def _closed(content: str) -> Column:
    return F.lit(content if content.endswith("\n") else content + "\n")


def replace_lines(text: Column, content: str, number: int | None = None, pattern: str | None = None) -> Column:
    """Replace a line by number (from 1), or every line that matches."""
    if number is not None:
        return F.array_join(F.transform(_lines(text), lambda x, i: F.when(i == number - 1, _closed(content)).otherwise(x)), "")
    return F.array_join(
        F.transform(_lines(text), lambda x: F.when(x.rlike(f"(?m){pattern}"), _closed(content)).otherwise(x)), ""
    )


def insert_lines(text: Column, content: str, number: int | None = None, pattern: str | None = None) -> Column:
    """Insert before a line number (one past the end appends), or after every line that matches."""
    lines = _lines(text)
    if number is None:
        added = F.transform(lines, lambda x: F.when(x.rlike(f"(?m){pattern}"), F.concat(x, _closed(content))).otherwise(x))
        return F.array_join(added, "")

    def inserted(ls: Column) -> Column:
        joined = F.concat(F.slice(ls, 1, number - 1), F.array(_closed(content)), F.slice(ls, number, F.size(ls) + 1))
        return F.when(F.size(ls) >= number - 1, F.array_join(joined, ""))

    return F.coalesce(let(lines, inserted), text)


def delete_lines(text: Column, number: int | None = None, pattern: str | None = None) -> Column:
    if number is not None:
        return F.array_join(F.filter(_lines(text), lambda x, i: i != number - 1), "")
    return F.array_join(F.filter(_lines(text), lambda x: ~x.rlike(f"(?m){pattern}")), "")


def json_path_values(document: Column, path: str) -> Column:
    """Values at a dotted path as an array of JSON texts; arrays on the way are crossed."""

    def items(value: Column) -> Column:
        return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))

    level = F.array(F.try_parse_json(document))
    for depth, key in enumerate(path.split(".")):
        if depth:
            level = F.flatten(F.transform(F.flatten(F.transform(level, items)), items))
        level = F.filter(_field(level, key), lambda v: v.isNotNull())
    return F.transform(level, lambda v: F.to_json(v))


def _field(values: Column, key: str) -> Column:
    return F.transform(values, lambda v: F.try_variant_get(v, f"$['{key}']", "variant"))


def write_back(
    df: DataFrame, key: list[str], document: str, schema: str, path: str, lookup: DataFrame, output: str
) -> DataFrame:
    """Write the looked-up text beside each text at ``path``: ``<field>_<output>`` at the root, ``<output>`` deeper.

    ``lookup`` has one row per text (value, result). Each document asks for each of its texts once; texts that occur
    in very many documents are spread by salt.
    """
    struct_type = T.StructType.fromDDL(schema)
    steps = path.split(".")
    name = f"{steps[0]}_{output}" if len(steps) == 1 else output
    rows = df.withColumn("__doc", F.from_json(document, struct_type))
    wanted = explode_items(
        rows.select(*key, F.array_distinct(_texts(F.col("__doc"), struct_type, steps)).alias("__t")), F.col("__t"), "value", keep=key
    )
    found = salted_join(wanted.filter("value IS NOT NULL"), lookup.select("value", "result"), ["value"])
    maps = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("value", "result"))).alias("__map"))
    joined = rows.join(maps, key, "left")
    changed = _with_result(F.col("__doc"), struct_type, steps, name)
    return joined.withColumn(document, F.to_json(changed)).drop("__doc", "__map")


def _texts(value: Column, kind: T.DataType, steps: list[str]) -> Column:
    nothing = F.array().cast("array<string>")
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda v: _texts(v, kind.elementType, steps))
        return F.coalesce(F.flatten(F.filter(inner, lambda x: x.isNotNull())), nothing)
    if not steps:
        return F.array(value) if isinstance(kind, T.StringType) else nothing
    return _texts(value[steps[0]], kind[steps[0]].dataType, steps[1:])


def _with_result(value: Column, kind: T.DataType, steps: list[str], name: str) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _with_result(v, kind.elementType, steps, name))
    if len(steps) == 1:
        return F.when(value.isNotNull(), value.withField(name, F.try_element_at("__map", value[steps[0]])))
    inner = _with_result(value[steps[0]], kind[steps[0]].dataType, steps[1:], name)
    return F.when(value.isNotNull(), value.withField(steps[0], inner))


def redact(text: Column) -> Column:
    """Mask secrets, keeping their last four characters, or the last two of secrets up to eight characters."""
    for lead, unit in SECRET_FORMS:
        outside = unit.replace("[^", "[", 1)
        value = rf"(?:{unit}{{5,}}({unit}{{4}})|{unit}{{0,6}}?({unit}{{1,2}}))(?=\z|{outside})"
        mark = "$1=***$2$3" if lead.endswith("=") else "$1***$2$3"
        text = F.regexp_replace(text, f"(?i){lead}{value}", mark)
    return text


def lenient_timestamp(text: Column) -> Column:
    """ISO date or time, else null."""
    iso = text.rlike(r"\A\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?(?:Z|[+-]\d{2}:\d{2})?)?\z")
    zone = r"(Z|[+-]\d{2}:\d{2})?\z"
    full = F.regexp_replace(F.regexp_replace(text, r"([T ]\d{2})" + zone, "$1:00$2"), r"([T ]\d{2}:\d{2})" + zone, "$1:00$2")
    return F.when(iso, F.try_to_timestamp(full))
