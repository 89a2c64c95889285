"""Registration, upserts, clean-up, ingestion, hashes."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillstack import schemas
from quillstack.operators import identity as ids
from quillstack.operators import versions as ve
from quillstack.operators.upsert import pending_counts, upsert
from quillstack.operators.chunk import ChunkConfig
from quillstack.plans.ingest import empty_state, ingest
from quillstack.session import shared_dir
from quillstack.sources import files
from quillstack.sources.snapshots import SnapshotTable


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    once = upsert(old, new, ["k"], order=["v"])
    twice = upsert(once, new, ["k"], order=["v"])
    expected = [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(map(tuple, once.collect())) == expected == sorted(map(tuple, twice.collect()))


def test_snapshots(spark):
    table = SnapshotTable(spark, shared_dir(spark, "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(spark.range(3))
    table.write(table.read().union(spark.range(10, 12)))
    assert table.versions() == [1, 2] and table.read().count() == 5 and table.read(1).count() == 3


def test_hashes_follow_canonical_json(spark):
    texts = ["plain", 'quo"te\\back', "tab\tnew\nline", "é ü 数据 😀", "\x00\x1b\x7f", ""]
    params = {"chunk_size": 10, "chunk_overlap": 2, "separators": ["。", "\n"], "other": 1}
    kept = {k: v for k, v in params.items() if k != "other"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", ids.chunk_hash(F.col("t"), params).alias("c"), ids.embed_hash(F.col("t"), F.lit("m/é")).alias("e")
    ).collect()
    for r in rows:
        def digest(value):
            return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

        assert r.c == digest({"text": r.t, "chunk_params": kept})
        assert r.e == digest({"text": r.t, "model": "m/é", "embed_params": {}})
    assert ids.parse_hash("pypdf", {"x": 1}) == ids.parse_hash("pypdf")


def test_ids(spark):
    cases = {"report 2024.pdf": "report_2024_pdf", "../../etc/passwd": "etc_passwd", "a__b--c_": "a_b--c", "x" * 80: "x" * 64}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", ids.sanitize_id(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases
    made = spark.range(1).select(ids.document_id(F.lit("kb1"), F.lit("/up/user 1/report.v2.docx")).alias("d")).first()["d"]
    assert made == "report_v2_" + hashlib.sha256(b"kb1|/up/user 1/report.v2.docx").hexdigest()[:8]
    tags = {"OpenAI/Text Embed-3": "OPENAI_text_embed_3", " BGE-m3 ": "bge_m3", "x/": "X"}
    rows = spark.createDataFrame([(c,) for c in tags], "t string").select("t", ids.model_tag(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == tags


def test_tenants(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, user_id int")
    assert schemas.tenant_filter(rows, 1).count() == 1
    assert schemas.tenant_filter(rows, None, True).count() == 3
    assert schemas.tenant_filter(rows, None).count() == 0


def test_schema_check(spark):
    good = schemas.empty_table(spark, "chunks")
    assert schemas.check_schema(good, "chunks") is good
    with pytest.raises(ValueError, match="text is missing"):
        schemas.check_schema(good.drop("text"), "chunks")


def tables(spark):
    docs = [("c'1", "d1"), ("c'1", "d2"), ("c2", "d1")]
    keys = "collection string, doc_id string"
    rows = [(c, d, p) for c, d in docs for p in ("p1", "p2")]
    embeddings = [(c, d, p, t) for c, d, p in rows for t in ("m1", "m2")]
    return {
        "documents": spark.createDataFrame(docs, keys),
        "parses": spark.createDataFrame(rows, keys + ", parse_hash string"),
        "chunks": spark.createDataFrame(rows, keys + ", parse_hash string"),
        "embeddings": spark.createDataFrame(embeddings, keys + ", parse_hash string, model_tag string"),
        "main_pointers": spark.createDataFrame(
            [], keys + ", step_type string, model_tag string, semantic_id string, technical_id string, created_at timestamp, updated_at timestamp"
        ),
    }


@pytest.mark.parametrize(
    "scope,args,planned",
    [
        ("document", {}, {"embeddings": 4, "chunks": 2, "parses": 2, "main_pointers": 0, "documents": 1}),
        ("document", {"model_tag": "m1"}, {"embeddings": 2, "chunks": 2, "parses": 2, "main_pointers": 0, "documents": 1}),
        ("parse", {"new_parse": "p2"}, {"embeddings": 2, "chunks": 1, "parses": 1}),
        ("parse", {"old_parse": "p1"}, {"embeddings": 2, "chunks": 1}),
        ("chunk", {"old_parse": "p1"}, {"embeddings": 2}),
        ("embeddings", {}, {"embeddings": 4}),
    ],
)
def test_preview_counts_equal_deletions(spark, scope, args, planned):
    before = tables(spark)
    conditions = ve.cascade_conditions(scope, "c'1", "d1", **args)
    preview = {r.table_name: r["rows"] for r in ve.cascade_preview(before, conditions).collect()}
    assert preview == planned
    after = ve.cascade_delete(before, conditions)
    for name, df in before.items():
        assert df.count() - after[name].count() == planned.get(name, 0)


def test_unknown_scope_and_version(spark):
    with pytest.raises(ValueError):
        ve.cascade_conditions("everything", "c", "d")
    candidates = tables(spark)["parses"].select(
        "collection", "doc_id", F.col("parse_hash").alias("technical_id"), F.lit("s").alias("semantic_id"), F.lit(1).alias("created_at")
    )
    with pytest.raises(ValueError):
        ve.promote(tables(spark), candidates, "parse", "c2", "d1", "none", F.current_timestamp())


def test_prompt_metadata_filter(spark):
    log = spark.createDataFrame(
        [("c", "a", 1, 1, '{"lang":"en"}'), ("c", "b", 1, 2, '{"lang":"de"}'), ("c", "b", 2, 3, "{bad")],
        "collection string, name string, version int, id int, metadata string",
    )
    assert [r.id for r in ve.list_prompts(log, metadata={"lang": "de"}).collect()] == [2]


def test_owner_backfill_with_a_hot_document(spark):
    docs = spark.createDataFrame([("c", 1, 7), ("c", 2, None)], "collection string, doc_id int, user_id long")
    rows = spark.range(3000).select(
        F.lit("c").alias("collection"), F.when(F.col("id") < 2900, 1).otherwise(2).alias("doc_id"), F.col("id").alias("chunk_id"),
        F.when(F.col("id") % 10 == 0, F.lit(9)).cast("long").alias("user_id"),
    )
    filled = ve.backfill_owner(rows, docs)
    assert ve.backfill_report(filled).first().asDict() == {"total": 3000, "backfilled": 2610, "skipped": 90}


def test_ingestion_is_idempotent(spark):
    incoming = spark.createDataFrame(
        [("kb", "/a.txt", "alpha beta. " * 30, 1), ("kb", "/b.txt", "gamma delta. " * 5, 2)],
        "collection string, source_path string, content string, uploaded_at int",
    )
    first = ingest(empty_state(incoming), incoming, ChunkConfig(100, 20))
    state = {"documents": first.documents, "chunks": first.chunks, "embeddings": first.embeddings}
    assert {r.created for r in first.report.collect()} == {True}
    second = ingest(state, incoming, ChunkConfig(100, 20))
    assert {(r.created, r.changed) for r in second.report.collect()} == {(False, False)}
    for name in state:
        assert sorted(map(str, getattr(second, name).collect())) == sorted(map(str, state[name].collect()))
    assert first.embeddings.count() == first.chunks.count() > 5


def test_pending_counts(spark):
    todo = spark.createDataFrame([("c", 1), ("c", 2), ("d", 3)], "g string, k int")
    done = spark.createDataFrame([(1,), (1,)], "k int")
    assert {tuple(r) for r in pending_counts(todo, done, ["k"], ["g"]).collect()} == {("c", 2, 1), ("d", 1, 1)}


def test_text_files_and_hidden_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfx")
    (tmp_path / "c.txt").write_bytes(b"caf\xe9")
    texts = {r.path[-5:]: r.text for r in files.read_text_files(spark, str(tmp_path)).collect()}
    assert texts == {"a.txt": "é", "b.txt": "x", "c.txt": "café"}
    assert files.list_files(spark, str(tmp_path)).count() == 3
    with pytest.raises(ValueError):
        files.export_result(spark.range(1), str(tmp_path / "x.xlsx"))
