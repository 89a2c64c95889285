"""The registered queries of the operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions.windows import salted_join
from quillstack.llm import bpe, collocation, fingerprint, language, lexical, mixing, neardup, quotes, rollups, simhash, spans, topk, urls
from quillstack.llm.common import word_count, written
from quillstack.session import apply_session_conf, load_table, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: Arrow batches small enough for long texts."""
    apply_session_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepared(spark), folder)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return wrap


@query("op1_order_minhash_classes")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return neardup.classes(load_table(spark, folder, "documents"))


#: Tokens of the second counting rule: runs of Latin letters, single digits, single other signs.
PIECES = r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]"


@query(
    "op2_delta_rollups",
    rf"""
    WITH counted AS (
        SELECT doc_id, source, lang, text,
               coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words,
               coalesce(len(regexp_extract_all(text, '{PIECES}')), 0) AS pieces
        FROM documents
    ), firsts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first_id FROM documents GROUP BY 1
    ), kept AS (
        SELECT c.* FROM counted c JOIN firsts f ON coalesce(c.text, '') = f.text AND c.doc_id = f.first_id
    ), tokens AS (
        SELECT source, lang, 'words-1' AS tokenizer, CASE WHEN lang = 'fr' THEN pieces ELSE words END AS n FROM kept
        UNION ALL SELECT source, lang, 'pieces-1', pieces FROM kept
    )
    SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens
    FROM tokens GROUP BY 1, 2, 3
    """,
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after three batches, two of them sent twice: all documents, French recounted, later copies deleted."""
    text = F.col("text")
    docs = load_table(spark, folder, "documents").select(
        "doc_id", "source", "lang", word_count(text).alias("words"), F.coalesce(F.regexp_count(text, F.lit(PIECES)), F.lit(0)).cast("long").alias("pieces"),
        F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"),
    )
    docs = written(docs, "rollup-counts")

    def changes(rows: DataFrame, op: str, words: str) -> DataFrame:
        both = F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.expr(c).cast("long").alias("tokens")) for n, c in (("words-1", words), ("pieces-1", "pieces"))])
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.inline(both)).withColumn("was_tokens", F.lit(0).cast("long"))

    table = rollups.Rollups(spark, shared_dir(spark, "rollups"))
    load = changes(docs, "insert", "words")
    recount = docs.filter("lang = 'fr'").select(
        F.lit("revise").alias("op"), "source", "lang", F.lit("words-1").alias("tokenizer"), F.col("pieces").alias("tokens"), F.col("words").alias("was_tokens")
    )
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    copies = salted_join(docs, first, ["digest"]).filter("doc_id > first_id")
    dropped = changes(copies, "delete", "CASE WHEN lang = 'fr' THEN pieces ELSE words END")
    for name, batch in (("1.load", load), ("2.recount", recount), ("1.load", load), ("3.copies", dropped), ("3.copies", dropped)):
        table.commit(name, batch)
    return table.totals()


@query("op3_bottom_k_sketch")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness."""
    docs = load_table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("sketch", fingerprint.sketch(F.col("text")))
    docs = fingerprint.with_next(docs, "doc_id", ["text", "sketch"])
    docs = docs.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text")))
    docs = docs.withColumn("edited_sketch", fingerprint.sketch(F.col("edited")))
    return docs.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprint.containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
        fingerprint.distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )


@query("op4_segmented_urls")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict for every page's url."""
    return urls.judge(load_table(spark, folder, "pages"))


@query("op5_language_mixture")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of every whole text, learned from the documents that are not held out."""
    docs = load_table(spark, folder, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language.held_out())
    profiles = language.learn(docs.filter("NOT held_out"))
    return language.predict(docs.select("doc_id", "text", "held_out"), profiles).drop("text")


@query("op6_compacted_spans")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every whole text without the windows of 20 words that occur earlier."""
    docs = load_table(spark, folder, "documents").select("doc_id", "text")
    left = spans.remove_spans(docs, spans.repeated_spans(docs))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op7_prefix_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text and the text they decode to, as digests."""
    docs = load_table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_quotation_links")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Replies found in mail made of the conversations: each turn quotes the two before it, the older one twice deep."""
    turns = load_table(spark, folder, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def before(n: int) -> DataFrame:
        marks = "> " * n
        return turns.dropDuplicates(["conv_id", "turn"]).select(
            "conv_id", (F.col("turn") + n).alias("turn"),
            F.concat(F.lit(marks), F.regexp_replace("text", "\n", "\n" + marks), F.lit("\n")).alias(f"quote_{n}"),
        )

    mail = turns.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    mail = mail.select(
        "conv_id", "turn", "role", F.concat(F.coalesce("quote_2", F.lit("")), F.coalesce("quote_1", F.lit("")), "text").alias("text")
    )
    return quotes.link_quotes(written(mail, "mail"))


@query("op9_split_tree_mix")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = load_table(spark, folder, "documents")
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    planned = mixing.plan(sized)
    return planned.select(
        F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_alike"), "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "source", "shard_of",
    ).drop("_alike")


@query(
    "op10_pivot_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """The five best rows by integer inner product for every 50th vector."""
    rows = load_table(spark, folder, "embeddings")
    return topk.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query(
    "op11_presence_mask_search",
    rf"""
    WITH cut AS (
        SELECT doc_id, list_transform(regexp_extract_all(text, '{TERM}'), lambda x: translate(x, {LETTERS})) AS terms
        FROM documents WHERE text IS NOT NULL
    ), docs AS (
        SELECT row_number() OVER () AS d, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM cut WHERE len(terms) > 0
    ), totals AS (
        SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs
    ), asked AS (
        SELECT i, term, count(*) AS times FROM (
            SELECT row_number() OVER () AS i, unnest(list_transform(regexp_extract_all(text, '{TERM}'), lambda x: translate(x, {LETTERS}))) AS term
            FROM benchmark WHERE text IS NOT NULL
        ) GROUP BY ALL
    ), named AS (
        SELECT row_number() OVER () AS i, item_id FROM benchmark WHERE text IS NOT NULL
    ), counts AS (
        SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM counts, totals GROUP BY term, docs
    ), shares AS (
        SELECT d, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))) AS share
        FROM counts JOIN weights USING (term) JOIN docs USING (d), totals
    ), scored AS (
        SELECT i, d, CAST(sum(times * share) AS BIGINT) AS score FROM asked JOIN shares USING (term) GROUP BY i, d
    ), ranked AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored JOIN docs USING (d) JOIN named USING (i) WHERE score > 0 AND doc_id IS NOT NULL
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.rank_documents(load_table(spark, folder, "documents"), load_table(spark, folder, "benchmark"))


@query("op12_simhash_components")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint of every whole text, and the component of fingerprints that it belongs to."""
    return simhash.near_components(load_table(spark, folder, "documents"))


@query(
    "op13_stream_collocations",
    rf"""
    WITH pieces AS (
        SELECT row_number() OVER () AS p, lang, words FROM (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, {LETTERS}), '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents WHERE text IS NOT NULL
            )
        ) WHERE len(words) > 0
    ), totals AS (
        SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang
    ), places AS (
        SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
    ), counts AS (
        SELECT lang, phrase, count(*) AS a FROM (
            SELECT lang, unnest(list_transform(range(i, least(i + 5, len(words) + 1)), lambda j: words[i:j])) AS phrase FROM places
        ) GROUP BY ALL HAVING count(*) >= 100
    ), cuts AS (
        SELECT lang, phrase, a, unnest(range(1, len(phrase))) AS k FROM counts WHERE len(phrase) > 1
    ), scored AS (
        SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n,
               CAST((1000 * CAST(c.a AS HUGEINT) * n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
        FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.phrase[1:k]
        JOIN counts r ON r.lang = c.lang AND r.phrase = c.phrase[k + 1:len(c.phrase)] JOIN totals t ON t.lang = c.lang
    ), lowest AS (
        SELECT DISTINCT ON (lang, phrase) * FROM scored ORDER BY lang, phrase, score, k
    ), inside AS (
        SELECT lang, phrase[1:len(phrase) - 1] AS phrase, a FROM counts WHERE len(phrase) > 2
        UNION ALL SELECT lang, phrase[2:len(phrase)], a FROM counts WHERE len(phrase) > 2
    ), kept AS (
        SELECT * FROM lowest p WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = p.lang AND x.phrase = p.phrase AND 100 * x.a >= 100 * p.a)
    ), named AS (
        SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM kept
    ), ranked AS (
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM named
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The collocations of every language."""
    return collocation.collocations(load_table(spark, folder, "documents"))
