"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.operators.upsert import upsert
from quillstack.registry import register
from quillstack.session import load_table, shared_dir
from quillstack.sources import files
from quillstack.sources.buckets import BucketTable
from quillstack.sources.snapshots import SnapshotTable
from quillstack.sources.sqlsource import SqlSource, run_sql

STAR = ["orders", "customer", "nation", "lineitem"]

REVENUE_SQL = """
SELECT n_name, count(DISTINCT o_orderkey) AS n_orders,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'
GROUP BY n_name
"""

ORDERS_DDL = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
    "o_orderpriority string"
)
ORDERS_ORACLE = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS order_us, o_orderpriority FROM orders
"""

# Paths derived from the documents: two thirds known extensions, one third not.
PATHS_SQL = """
SELECT doc_id, source || '/' || lang || '/Doc ' || doc_id || '.' ||
       CASE doc_id % 12 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'PDF' WHEN 3 THEN 'json' WHEN 4 THEN 'htm'
            WHEN 5 THEN 'jpeg' WHEN 6 THEN 'docx' WHEN 7 THEN 'csv' WHEN 8 THEN 'rst' WHEN 9 THEN 'exe'
            WHEN 10 THEN 'tar.gz' ELSE 'xlsx' END AS path,
       CASE doc_id % 5 WHEN 0 THEN 'deepdoc' WHEN 1 THEN 'unstructured' WHEN 2 THEN 'pypdf' WHEN 3 THEN 'pymupdf'
            ELSE 'other' END AS method
FROM documents
"""


def paths_of(spark, folder):
    return run_sql(spark, SqlSource(folder, ["documents"]), PATHS_SQL)


@register("s1_run_sql", REVENUE_SQL)
def s1(spark, folder):
    return run_sql(spark, SqlSource(folder, STAR), REVENUE_SQL)


def exported_orders(spark, folder, suffix):
    path = shared_dir(spark, "export") + suffix
    run_sql(spark, SqlSource(folder, ["orders"]), "SELECT * FROM orders", output_path=path)
    return path


def orders_out(df):
    return df.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.unix_micros("o_orderdate").alias("order_us"),
        "o_orderpriority",
    )


@register("s2_export_csv", ORDERS_ORACLE)
def s2(spark, folder):
    return orders_out(files.read_csv(spark, exported_orders(spark, folder, ".csv"), ORDERS_DDL))


@register("s3_export_json_lines", ORDERS_ORACLE)
def s3(spark, folder):
    return orders_out(files.read_json(spark, exported_orders(spark, folder, ".jsonl"), ORDERS_DDL))


@register("s4_export_parquet", ORDERS_ORACLE)
def s4(spark, folder):
    return orders_out(spark.read.parquet(exported_orders(spark, folder, ".parquet")))


@register(
    "s5_s6_csv_documents",
    "SELECT doc_id, lang, source, text, length(text) AS chars FROM documents",
)
def s5(spark, folder):
    """Texts with line breaks, quotes and separators survive a semicolon CSV."""
    path = shared_dir(spark, "csv")
    files.write_csv(load_table(spark, folder, "documents").select("doc_id", "lang", "source", "text"), path, sep=";")
    back = files.read_csv(spark, path, "doc_id bigint, lang string, source string, text string", sep=";")
    return back.withColumn("chars", F.length("text"))


@register("s7_s8_json_conversations", "SELECT conv_id, turn, role, text FROM conversations")
def s7(spark, folder):
    path = shared_dir(spark, "json")
    files.write_json(load_table(spark, folder, "conversations"), path)
    return files.read_json(spark, path, "conv_id bigint, turn bigint, role string, text string")


@register(
    "s9_decode_text",
    """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN regexp_replace(text, '[^\\x00-\\x{ff}]', '?', 'g') ELSE text END AS text
FROM documents
""",
)
def s9(spark, folder):
    """Bytes in UTF-8, UTF-8 with mark, and Latin-1 (which is not valid UTF-8 when it has accents)."""
    text = F.col("text")
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))
    latin = F.encode(F.regexp_replace(text, r"[^\x00-\x{ff}]", "?"), "ISO-8859-1")
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode(text, "UTF-8")).when(F.col("doc_id") % 3 == 1, marked).otherwise(latin)
    docs = load_table(spark, folder, "documents")
    return docs.select("doc_id", files.decode_bytes(raw).alias("text"))


@register(
    "s1_affected_rows",
    """
SELECT 'update' AS statement, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000) AS n, 0 AS total
UNION ALL SELECT 'delete', (SELECT count(*) FROM orders WHERE o_orderpriority LIKE '5%'), 0
UNION ALL SELECT 'left', count(*), floor(sum(CASE WHEN o_orderstatus = 'O' AND o_totalprice > 1000 THEN 1 ELSE 0 END))::INT FROM orders WHERE o_orderpriority NOT LIKE '5%'
""",
)
def s1_affected(spark, folder):
    """Rows that an update and a deletion touch, counted by the writes themselves."""
    table = SnapshotTable(spark, shared_dir(spark, "orders"))
    table.write(load_table(spark, folder, "orders"))
    updated = table.update("o_orderstatus = 'O' AND o_totalprice > 1000", {"o_orderstatus": "'X'", "o_totalprice": "o_totalprice * 2"})
    deleted = table.delete("o_orderpriority LIKE '5%'")
    left = table.read().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "X").cast("int").alias("total")).select(F.lit("left").alias("statement"), "n", "total")
    done = spark.createDataFrame([("update", updated, 0), ("delete", deleted, 0)], "statement string, n long, total int")
    return done.unionByName(left)


@register("s10_list_files")
def s10(spark, folder):
    """Names and sizes of the table files below the given folder."""
    return files.list_files(spark, folder, glob="*.parquet").select("name", "size")


@register(
    "s11_file_type",
    f"""
WITH p AS ({PATHS_SQL}), e AS (
  SELECT doc_id, path, lower(regexp_extract(path, '(\\.[^.]+)$', 1)) AS ext FROM p),
t AS (SELECT doc_id, path, ext, CASE ext WHEN '.txt' THEN 'txt' WHEN '.md' THEN 'md' WHEN '.pdf' THEN 'pdf'
  WHEN '.json' THEN 'json' WHEN '.htm' THEN 'html' WHEN '.jpeg' THEN 'image' WHEN '.docx' THEN 'docx'
  WHEN '.csv' THEN 'csv' WHEN '.xlsx' THEN 'xlsx' END AS file_type FROM e)
SELECT doc_id, path, file_type, CASE WHEN file_type IS NULL THEN 'Unsupported file type: ' || ext END AS error FROM t
""",
)
def s11(spark, folder):
    return files.with_file_type(paths_of(spark, folder).select("doc_id", "path"))


@register(
    "s12_detect_format",
    """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'pptx'
       WHEN 4 THEN 'xls' WHEN 5 THEN 'doc' ELSE 'md' END AS format FROM documents
""",
)
def s12(spark, folder):
    """Document texts wrapped in the leading bytes of several formats under a misleading extension."""
    case = F.col("doc_id") % 7
    head = (
        F.when(case == 0, F.unhex(F.lit("255044462D312E37")))
        .when(case.isin(1, 2, 3), F.unhex(F.lit("504B030414000600")))
        .when(case.isin(4, 5), F.unhex(F.lit("D0CF11E0A1B11AE1")))
        .otherwise(F.unhex(F.lit("")))
    )
    member = (
        F.when(case == 1, F.lit("[Content_Types].xml word/document.xml"))
        .when(case == 2, F.lit("[Content_Types].xml xl/workbook.xml"))
        .when(case == 3, F.lit("[Content_Types].xml ppt/presentation.xml"))
        .otherwise(F.lit(""))
    )
    ext = F.when(case == 4, F.lit(".xlsx")).when(case == 5, F.lit(".docx")).otherwise(F.lit(".md"))
    docs = load_table(spark, folder, "documents").select(
        "doc_id",
        F.concat(head, F.encode(F.concat(member, F.col("text")), "UTF-8")).alias("content"),
        F.concat(F.col("source"), F.lit("/f"), ext).alias("path"),
    )
    return docs.select("doc_id", files.detect_format(F.col("content"), F.col("path")).alias("format"))


@register(
    "s13_parser_violations",
    f"""
WITH p AS ({PATHS_SQL}), c(ext, method) AS (VALUES ('.pdf','deepdoc'),('.pdf','pymupdf'),('.pdf','pdfplumber'),
 ('.pdf','unstructured'),('.pdf','pypdf'),('.docx','deepdoc'),('.docx','unstructured'),('.txt','unstructured'),
 ('.txt','deepdoc'),('.md','unstructured'),('.md','deepdoc'),('.json','unstructured'),('.json','deepdoc'),
 ('.xlsx','unstructured'),('.xlsx','deepdoc'),('.csv','deepdoc'))
SELECT doc_id, path, method FROM p
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.method = p.method AND c.ext = lower(regexp_extract(p.path, '(\\.[^.]+)$', 1)))
""",
)
def s13(spark, folder):
    return files.parser_violations(paths_of(spark, folder))


@register(
    "s14_unregistered_files",
    f"""
WITH p AS ({PATHS_SQL}) SELECT path FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""",
)
def s14(spark, folder):
    """Stored paths are those of all documents, the registry holds the labelled ones."""
    listing = paths_of(spark, folder)
    registry = listing.join(load_table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    return files.unregistered_files(listing, registry).select("path")


@register(
    "s14_register_found",
    f"""
WITH p AS ({PATHS_SQL}), f AS (SELECT doc_id, 'files/user_' || (doc_id % 7) || '/' || path AS path, length(path) AS size FROM p)
SELECT path, regexp_extract(path, '[^/]*$') AS name, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'known' ELSE 'found' END AS origin,
  doc_id % 7 AS user_id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN size END AS size FROM f
""",
)
def s14_register(spark, folder):
    """Files in seven users' folders; the registry knows those of labelled documents and learns of the others, once."""
    user = F.concat(F.lit("files/user_"), (F.col("doc_id") % 7).cast("string"), F.lit("/"))
    listing = paths_of(spark, folder).select("doc_id", F.concat(user, "path").alias("path"), F.length("path").cast("long").alias("size"))
    known = listing.join(load_table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi").select(
        "path", F.regexp_extract("path", r"[^/]*\z", 0).alias("name"), (F.col("doc_id") % 7).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(0)).alias("registered_at")
    )
    at = F.timestamp_seconds(F.lit(1))
    twice = files.register_found(listing, files.register_found(listing, known, at), at)
    return twice.select("path", "name", F.when(F.unix_timestamp("registered_at") == 0, "known").otherwise("found").alias("origin"), "user_id", "size")


@register(
    "s15_upsert_orders",
    """
WITH new AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, epoch_us(o_orderdate) AS order_us,
         o_orderpriority FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL
  SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate), o_orderpriority
  FROM orders WHERE o_orderkey % 10 = 1)
SELECT * FROM new UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate), o_orderpriority
FROM orders WHERE o_orderkey % 10 <> 0
""",
)
def s15(spark, folder):
    """The change set holds each changed order twice; the dearer copy wins. Both states are snapshots of one table."""
    orders = load_table(spark, folder, "orders")
    table = SnapshotTable(spark, shared_dir(spark, "orders"))
    table.write(orders)
    changed = orders.filter(F.col("o_orderkey") % 10 == 0)
    added = orders.filter(F.col("o_orderkey") % 10 == 1).withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    new = changed.unionByName(changed.withColumn("o_totalprice", F.col("o_totalprice") + 1)).unionByName(added)
    table.write(upsert(table.read(), new, ["o_orderkey"], order=["o_totalprice"]))
    return orders_out(table.read())


@register(
    "s15_bucketed_changes",
    """
WITH busy AS (SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY o_custkey),
changed AS (SELECT o.* REPLACE (o_totalprice + 1 AS o_totalprice) FROM orders o JOIN busy b ON b.o_custkey = o.o_custkey AND o_totalprice = most)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS order_us, o_orderpriority FROM (
  SELECT * FROM changed UNION ALL SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changed))
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)
""",
)
def s15_buckets(spark, folder):
    """The dearest order of each customer changes and orders with large returns go; only their buckets are written."""
    orders = load_table(spark, folder, "orders")
    table = BucketTable(spark, shared_dir(spark, "orders"), ["o_orderkey"], buckets=16)
    table.upsert(orders)
    most = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    changed = orders.join(most, ["o_custkey", "o_totalprice"], "left_semi").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    table.upsert(changed)
    table.delete(load_table(spark, folder, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")))
    return orders_out(table.read())
