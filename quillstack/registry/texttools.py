"""Text, CSV and JSON tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.operators import textops as tx
from quillstack.registry import register
from quillstack.registry import sqltext as q
from quillstack.session import load_table, shared_dir, spread
from quillstack.sources import files

WORD = q.quote(q.NOT_SPACE + "+")


def docs(spark, folder):
    return spread(load_table(spark, folder, "documents"), "doc_id")


@register(
    "x1_text_profile",
    f"""
SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, {WORD})) AS words,
  CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS preview, len(string_split(text, chr(10))) > 100 AS many_lines,
  len(regexp_extract_all(text, {WORD})) > 1000 AS many_words FROM documents
""",
)
def x1(spark, folder):
    return tx.text_profile(docs(spark, folder)).select("doc_id", "lines", "words", "preview", "many_lines", "many_words")


JSONS = """js AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '[' || props || ', [1, "a]}", []], {}]'
 WHEN 2 THEN '{"a": ' || props || ', "b": {"c": [' || props || ']}}' WHEN 3 THEN '"te\\"xt{"' ELSE '{broken' END AS j FROM events)"""


def json_texts(spark, folder):
    p = F.col("props")
    case = F.col("event_id") % 5
    j = (
        F.when(case == 0, p)
        .when(case == 1, F.concat(F.lit("["), p, F.lit(', [1, "a]}", []], {}]')))
        .when(case == 2, F.concat(F.lit('{"a": '), p, F.lit(', "b": {"c": ['), p, F.lit("]}}")))
        .when(case == 3, F.lit('"te\\"xt{"'))
        .otherwise(F.lit("{broken"))
    )
    return load_table(spark, folder, "events").select("event_id", j.alias("j"))


@register(
    "x2_json_profile",
    f"""
WITH {JSONS} SELECT event_id, ['object', 'array', 'object', 'string', 'none'][1 + event_id % 5] AS kind,
  CASE WHEN event_id % 5 IN (0, 2) THEN len(json_keys(j)) ELSE -1 END AS keys,
  CASE WHEN event_id % 5 = 1 THEN json_array_length(j)::INT ELSE -1 END AS items, [1, 2, 4, 0, -1][1 + event_id % 5] AS depth FROM js
""",
)
def x2(spark, folder):
    profiled = tx.json_profile(json_texts(spark, folder), "j")
    none = F.lit(-1)
    return profiled.select(
        "event_id", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("keys", none).alias("keys"),
        F.coalesce("items", none).alias("items"), F.coalesce("depth", none).alias("depth"),
    )


def orders_csv(spark, folder):
    path = shared_dir(spark, "profile") + ".csv"
    files.write_csv(load_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return files.read_csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")


@register("x3_csv_profile", "SELECT count(*) AS rows, 4 AS columns, count(*) > 1000 AS large, false AS wide FROM orders")
def x3(spark, folder):
    return tx.csv_profile(orders_csv(spark, folder))[0]


@register(
    "x3_csv_preview",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY ALL LIMIT 5",
)
def x3_preview(spark, folder):
    return tx.csv_profile(orders_csv(spark, folder))[1]


@register(
    "x4_markdown_profile",
    """
SELECT doc_id, len(list_filter(string_split(t, chr(10)), lambda l: starts_with(l, '#'))) AS headers,
  len(regexp_extract_all(t, '```')) // 2 AS code_blocks, len(string_split(t, chr(10))) AS lines
FROM (SELECT doc_id, '# ' || lang || chr(10) || replace(text, ' de ', ' ``` ') || chr(10) || '## ' || source || chr(10) || text AS t FROM documents)
""",
)
def x4(spark, folder):
    text = F.concat(
        F.lit("# "), "lang", F.lit("\n"), F.replace("text", F.lit(" de "), F.lit(" ``` ")), F.lit("\n## "), "source", F.lit("\n"), "text"
    )
    rows = docs(spark, folder).select("doc_id", text.alias("text"))
    return tx.markdown_profile(rows).drop("text")


@register(
    "x5_find_replace",
    """
SELECT doc_id, replace(text, '. ', '$1.\\n') AS literal, len(string_split(text, '. ')) - 1 AS literal_n,
  regexp_replace(text, '(?i)\\bth(e|at)\\b', '<\\1>', 'g') AS by_regex, len(regexp_extract_all(text, '(?i)\\bth(e|at)\\b')) AS regex_n
FROM documents
""",
)
def x5(spark, folder):
    literal, literal_n = tx.find_replace(F.col("text"), ". ", "$1.\\n")
    by_regex, regex_n = tx.find_replace(F.col("text"), r"\bth(e|at)\b", "<$1>", use_regex=True, case_sensitive=False)
    return docs(spark, folder).select(
        "doc_id", literal.alias("literal"), literal_n.alias("literal_n"), by_regex.alias("by_regex"), regex_n.alias("regex_n")
    )


@register(
    "x6_line_edits",
    """
WITH l AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 2 THEN 'new' || chr(10) ELSE x END), '') AS replaced,
  array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^The') THEN x || 'after' || chr(10) ELSE x END), '') AS inserted,
  CASE WHEN len(l) >= 2 THEN array_to_string(list_concat(list_concat(l[1:2], ['third' || chr(10)]), l[3:]), '') ELSE text END AS third,
  array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, 'an')), '') AS deleted,
  array_to_string(list_filter(l, lambda x, i: i <> 1), '') AS tail FROM l
""",
)
def x6(spark, folder):
    t = F.col("text")
    return docs(spark, folder).select(
        "doc_id", tx.replace_lines(t, "new", number=2).alias("replaced"), tx.insert_lines(t, "after", pattern="^The").alias("inserted"),
        tx.insert_lines(t, "third", number=3).alias("third"), tx.delete_lines(t, pattern="an").alias("deleted"),
        tx.delete_lines(t, number=1).alias("tail"),
    )


SEGMENTS = """sg AS (SELECT conv_id, '{"title":"c' || conv_id || '","segments":[' || string_agg('{"text":"' || role || '","n":' || turn || '}', ',' ORDER BY turn) || ']}' AS j
  FROM conversations GROUP BY conv_id)"""


def segment_docs(spark, folder):
    """One JSON document per conversation, listing the roles of its turns."""
    rows = load_table(spark, folder, "conversations").select("conv_id", "turn", F.struct(F.col("role").alias("text"), F.col("turn").alias("n")).alias("s"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "s")))
    grouped = rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: x["s"]).alias("segments"))
    title = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    return grouped.select("conv_id", F.to_json(F.struct(title.alias("title"), "segments")).alias("j"))


@register(
    "x7_json_path_values",
    """
SELECT conv_id, array_to_string(list(role ORDER BY turn), ',') AS texts, 'c' || conv_id AS title, array_to_string(list(turn ORDER BY turn), ',') AS ns
FROM conversations GROUP BY conv_id
""",
)
def x7(spark, folder):
    def at(path):
        return F.array_join(tx.json_path_values(F.col("j"), path), ",")

    return segment_docs(spark, folder).select(
        "conv_id", F.replace(at("segments.text"), F.lit('"'), F.lit("")).alias("texts"),
        F.replace(at("title"), F.lit('"'), F.lit("")).alias("title"), at("segments.n").alias("ns"),
    )


@register(
    "x8_write_back",
    """
SELECT conv_id, '{"title":"c' || conv_id || '","segments":[' || string_agg('{"text":"' || role || '","n":' || turn
   || CASE WHEN role <> 'system' THEN ',"translated":"' || upper(role) || '"' ELSE '' END || '}', ',' ORDER BY turn) || ']'
   || CASE WHEN conv_id % 2 = 0 THEN ',"title_translated":"C' || conv_id || '"' ELSE '' END || '}' AS j
FROM conversations GROUP BY conv_id
""",
)
def x8(spark, folder):
    """Roles are translated inside the segments, titles of even conversations at the root."""
    rows = segment_docs(spark, folder)
    turns = load_table(spark, folder, "conversations")
    roles = turns.filter("role <> 'system'").select(F.col("role").alias("value"), F.upper("role").alias("result")).distinct()
    schema = "title string, segments array<struct<text:string,n:bigint>>"
    inside = tx.write_back(rows, ["conv_id"], "j", schema, "segments.text", roles, "translated")
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    titles = turns.filter("conv_id % 2 = 0").select(name.alias("value"), F.upper(name).alias("result")).distinct()
    schema = "title string, segments array<struct<text:string,n:bigint,translated:string>>"
    return tx.write_back(inside, ["conv_id"], "j", schema, "title", titles, "translated")


@register(
    "x9_redact_secrets",
    """
SELECT doc_id, text || ' token=***' || right(sha256(text)[1:12], 4) || ' password=***23 x-api-key: ***' || right(md5(text), 4)
  || ', Authorization: Bearer ***' || right(sha1(text), 4) || ' http://h/p?a=1&key=***z9&b=2' AS text FROM documents
""",
)
def x9(spark, folder):
    t = F.col("text")
    secret = F.concat(
        t, F.lit(" token="), F.substring(F.sha2(t, 256), 1, 12), F.lit(" password=abc123 x-api-key: "), F.md5(t),
        F.lit(", Authorization: Bearer "), F.sha1(t), F.lit(" http://h/p?a=1&key=z9&b=2"),
    )
    return docs(spark, folder).select("doc_id", tx.redact(secret).alias("text"))


@register(
    "x10_lenient_timestamp",
    """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(date_trunc('second', ts)) WHEN 2 THEN epoch_us(date_trunc('day', ts))
  WHEN 3 THEN epoch_us(date_trunc('minute', ts)) - 7200000000 ELSE -1 END AS us FROM events
""",
)
def x10(spark, folder):
    ts = F.col("ts")
    case = F.col("event_id") % 5
    raw = (
        F.when(case == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(case == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(case == 2, F.date_format(ts, "yyyy-MM-dd"))
        .when(case == 3, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"), F.lit("+02:00")))
        .otherwise(F.date_format(ts, "dd/MM/yyyy"))
    )
    parsed = tx.lenient_timestamp(raw)
    return load_table(spark, folder, "events").select("event_id", F.coalesce(F.unix_micros(parsed), F.lit(-1)).alias("us"))


CODE = "replace(replace(replace(text, ' de ', ' import '), ' and ', chr(10) || 'def '), ' the ', ' class ')"


@register(
    "x11_code_profile",
    f"""
SELECT doc_id, len(string_split(t, chr(10))) AS lines, len(string_split(t, 'import ')) - 1 AS n_import, len(string_split(t, 'from ')) - 1 AS n_from,
  len(string_split(t, 'class ')) - 1 AS n_class, len(string_split(t, 'def ')) - 1 AS n_def FROM (SELECT doc_id, {CODE} AS t FROM documents)
""",
)
def x11(spark, folder):
    text = F.replace("text", F.lit(" de "), F.lit(" import "))
    text = F.replace(F.replace(text, F.lit(" and "), F.lit("\ndef ")), F.lit(" the "), F.lit(" class "))
    return tx.code_profile(docs(spark, folder).select("doc_id", text.alias("text"))).drop("text")


@register(
    "x12_generic_preview",
    """
WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents)
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '[Binary or non-text file]' ELSE
  array_to_string(list_transform(l[1:10], lambda x: regexp_replace(x, '\\s+$', '')), chr(10)) || CASE WHEN len(l) >= 10 THEN chr(10) || '...' ELSE '' END END AS preview
FROM l
""",
)
def x12(spark, folder):
    """Every sixth file starts with a byte that is no UTF-8."""
    raw = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 6 == 0, F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw)
    return docs(spark, folder).select("doc_id", tx.generic_preview(content).alias("preview"))
