"""Memory notes and transcripts."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quillstack.operators import notes as nt
from quillstack.operators import transcript as tr
from quillstack.registry import register
from quillstack.registry import sqltext as q
from quillstack.registry.vectors import L2, query_vector
from quillstack.session import load_table

# Documents as notes: category is the language, tags are the source and a size class.
NOTES = """
nt AS (SELECT doc_id AS id, text AS content, lang AS category, [source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END] AS tags,
  [lang, 'w' || (doc_id % 4)] AS keywords, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (doc_id % 700) AS ts,
  CASE WHEN doc_id % 3 <> 0 THEN doc_id % 3 END AS user_id, source FROM documents)
"""


def notes(spark, folder):
    i = F.col("doc_id")
    return load_table(spark, folder, "documents").select(
        i.alias("id"), F.col("text").alias("content"), F.col("lang").alias("category"),
        F.array("source", F.when(F.col("n_chars") > 2000, F.lit("long")).otherwise(F.lit("short"))).alias("tags"),
        F.array("lang", F.concat(F.lit("w"), (i % 4).cast("string"))).alias("keywords"),
        F.timestamp_seconds(F.lit(1704067200) + (i % 700) * 60).alias("timestamp"),
        F.create_map(F.lit("source"), F.col("source")).alias("metadata"),
        F.when(i % 3 != 0, i % 3).alias("user_id"),
    )


@register(
    "n1_search_notes",
    f"WITH {NOTES} SELECT id, category FROM nt WHERE contains(lower(content), 'then') AND category = 'en' AND source = 'src3' ORDER BY id LIMIT 7",
)
def n1(spark, folder):
    return nt.search_notes(notes(spark, folder), "THEN", 7, "en", {"source": "src3"}).select("id", "category")


def vector_notes(spark, folder):
    vectors = load_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return notes(spark, folder).join(vectors, "id")


NEAR = f"""SELECT id, round(d, 6) AS distance FROM (SELECT nt.id, {L2} AS d FROM nt JOIN embeddings e ON nt.id = e.vec_id,
  (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {{cond}}) WHERE d <= {{limit}} ORDER BY d, id LIMIT 6"""


@register("n2_vector_notes", f"WITH {NOTES} " + NEAR.format(cond="category = 'en'", limit=1.9))
def n2(spark, folder):
    found = nt.search_notes_by_vector(vector_notes(spark, folder), query_vector(spark, folder), "the", 6, 1.9, category="en")
    return found.select("id", F.round("distance", 6).alias("distance"))


@register(
    "n2_vector_notes_fallback",
    f"WITH {NOTES} SELECT id, -1.0::DOUBLE AS distance FROM nt JOIN embeddings e ON nt.id = e.vec_id WHERE category = 'fr' AND contains(lower(content), 'eau') ORDER BY id LIMIT 6",
)
def n2_fallback(spark, folder):
    """No note is that near, so the text search answers."""
    return nt.search_notes_by_vector(
        vector_notes(spark, folder), query_vector(spark, folder), "EAU", 6, -1.0, category="fr"
    )


@register(
    "n3_list_notes",
    f"""WITH {NOTES} SELECT id, category, epoch_us(ts) AS ts_us FROM nt WHERE list_contains(tags, 'long') AND list_contains(keywords, 'w1')
  AND ts BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 10:00:00'""",
)
def n3(spark, folder):
    found = nt.list_notes(
        notes(spark, folder), None, datetime.datetime(2024, 1, 1, 1), datetime.datetime(2024, 1, 1, 10), ["long"], ["w1"]
    )
    return found.select("id", "category", F.unix_micros("timestamp").alias("ts_us"))


@register(
    "n4_note_counts",
    f"""WITH {NOTES} SELECT 'category' AS kind, category AS value, count(*) AS notes FROM nt GROUP BY ALL
UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest(tags) AS t FROM nt) GROUP BY t""",
)
def n4(spark, folder):
    return nt.note_counts(notes(spark, folder))


@register(
    "n5_relevant_notes",
    f"""
WITH {NOTES}, h AS (SELECT *, list_position(['fr', 'en', 'es'], category) AS place, row_number() OVER (PARTITION BY category ORDER BY id) AS rank
  FROM nt WHERE category IN ('fr', 'en', 'es') AND contains(lower(content), 'an')),
u AS (SELECT * FROM h WHERE rank <= 40 QUALIFY row_number() OVER (PARTITION BY content ORDER BY place, rank) = 1)
SELECT id, category, rank FROM u ORDER BY place, rank LIMIT 90
""",
)
def n5(spark, folder):
    found = nt.relevant_notes(notes(spark, folder), "an", ["fr", "en", "es"], 40, 90)
    return found.select("id", "category", "rank")


@register(
    "n6_change_notes",
    f"""
WITH {NOTES} SELECT id, CASE WHEN id % 5 = 0 THEN 'edited' ELSE category END AS category FROM nt WHERE id % 7 <> 0
UNION ALL SELECT id + 5000000, 'added' FROM nt WHERE id % 50 = 1
""",
)
def n6(spark, folder):
    """Every fifth note is edited, some are added, every seventh is deleted."""
    rows = notes(spark, folder).drop("metadata")
    edited = rows.filter("id % 5 = 0").withColumn("category", F.lit("edited"))
    added = rows.filter("id % 50 = 1").withColumn("id", F.col("id") + 5_000_000).withColumn("category", F.lit("added"))
    saved = nt.save_notes(rows, edited.unionByName(added))
    return nt.delete_notes(saved, rows.filter("id % 7 = 0")).select("id", "category")


@register(
    "n7_note_page",
    f"WITH {NOTES} SELECT id, epoch_us(ts) AS ts_us, (SELECT count(*) FROM nt) AS total FROM nt ORDER BY ts DESC, id LIMIT 25 OFFSET 50",
)
def n7(spark, folder):
    shown = nt.note_page(notes(spark, folder).select("id", "timestamp"), 3, 25)
    return shown.select("id", F.unix_micros("timestamp").alias("ts_us"), "total")


@register(
    "n13_owner_statistics",
    f"""
WITH {NOTES}, u AS (SELECT 'user 1' AS seen_by, category FROM nt WHERE user_id = 1 UNION ALL SELECT 'admin', category FROM nt)
SELECT seen_by, category, count(*) AS notes FROM u GROUP BY ALL
""",
)
def n13(spark, folder):
    """Counts as user 1, as admin, and as nobody (who sees nothing)."""
    rows = notes(spark, folder)
    views = [("user 1", nt.notes_of(rows, 1)), ("admin", nt.notes_of(rows, None, True)), ("nobody", nt.notes_of(rows, None))]
    out = None
    for name, seen in views:
        part = seen.select(F.lit(name).alias("seen_by"), "category")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("seen_by", "category").agg(F.count(F.lit(1)).alias("notes"))


# Conversations with a system message first, odd spelling of roles and some empty messages.
MESSAGES = """
m AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN ' System ' WHEN turn % 7 = 6 THEN 'tool' ELSE upper(role) END AS role,
  CASE WHEN (conv_id + turn) % 11 = 3 THEN '  ' ELSE text END AS text FROM conversations)"""
CLEAN = f"""{MESSAGES}, cl AS (SELECT conv_id, turn, lower(trim(role)) AS role, {q.strip('text')} AS text FROM m
  WHERE lower(trim(role)) IN ('user', 'assistant', 'system') AND {q.has_content('text')})"""


def messages(spark, folder):
    role = F.when(F.col("turn") == 0, F.lit(" System ")).when(F.col("turn") % 7 == 6, F.lit("tool")).otherwise(F.upper("role"))
    text = F.when((F.col("conv_id") + F.col("turn")) % 11 == 3, F.lit("  ")).otherwise(F.col("text"))
    return load_table(spark, folder, "conversations").withColumn("role", role).withColumn("text", text)


def clean(spark, folder):
    return tr.normalize_messages(messages(spark, folder))


@register("n8_normalize_messages", f"WITH {CLEAN} SELECT * FROM cl")
def n8(spark, folder):
    return clean(spark, folder)


@register(
    "n9_messages_before",
    f"""
WITH {CLEAN}, k AS (SELECT conv_id, 2 + conv_id % 3 AS b FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT cl.* FROM cl JOIN k USING (conv_id) WHERE turn < b AND EXISTS (SELECT 1 FROM cl c2 WHERE c2.conv_id = k.conv_id AND c2.turn = b)
""",
)
def n9(spark, folder):
    marks = load_table(spark, folder, "conversations").select("conv_id").distinct()
    return tr.messages_before(clean(spark, folder), marks.withColumn("before", 2 + F.col("conv_id") % 3))


TRUNCATED = """
tn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS n,
       count(*) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS s FROM cl),
tc AS (SELECT conv_id, turn, role, text FROM tn WHERE role = 'system' OR n <= 3 - s)"""


@register("n10_truncate_messages", f"WITH {CLEAN}, {TRUNCATED} SELECT * FROM tc")
def n10(spark, folder):
    return tr.truncate_messages(clean(spark, folder), 3)


@register(
    "n11_token_estimates",
    f"WITH {CLEAN} SELECT conv_id, sum(length(text))::BIGINT // 4 AS tokens, count(*) AS messages FROM cl GROUP BY conv_id",
)
def n11(spark, folder):
    return tr.token_estimates(clean(spark, folder))


@register("n11_rendered_lines", f"WITH {CLEAN} SELECT conv_id, turn, upper(role) || ': ' || text AS line FROM cl")
def n11_lines(spark, folder):
    return tr.rendered_lines(clean(spark, folder))


@register(
    "n11_rendered_transcript",
    f"WITH {CLEAN} SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM cl GROUP BY conv_id",
)
def n11_text(spark, folder):
    """Whole conversations as text."""
    return tr.rendered_transcript(clean(spark, folder))


@register(
    "n12_fit_to_budget",
    f"""
WITH {CLEAN}, s AS (SELECT conv_id, sum(length(text))::BIGINT // 4 AS used FROM cl WHERE role = 'system' GROUP BY conv_id),
r AS (SELECT cl.*, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total FROM cl WHERE role <> 'system')
SELECT conv_id, turn, role, text FROM cl WHERE role = 'system'
UNION ALL SELECT conv_id, turn, role, text FROM r LEFT JOIN s USING (conv_id) WHERE total + coalesce(used, 0) <= 250
""",
)
def n12(spark, folder):
    return tr.fit_to_budget(clean(spark, folder), 250, bucket_turns=2)
