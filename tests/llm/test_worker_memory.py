"""What Python workers hold: nothing of an earlier step, and ids of a bounded part of a batch."""

import sys

import pyarrow as pa

from quillstack.llm import bpe, common, language

DOCS = "doc_id long, text string, lang string"


def _held(spark):
    """Largest number of objects kept in a worker; more tasks than cores, so that reused workers are looked into."""

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(vars(sys).get("_quillstack_kept", {}))] * batch.num_rows})

    return max(r.n for r in spark.range(0, 64, 1, 16).mapInArrow(kept, "n long").collect())


def test_encoder_goes_when_another_step_begins(spark):
    docs = spark.createDataFrame([(i, f"bala bolu {i}", "aa") for i in range(64)], DOCS).repartition(16)
    bpe.encode(docs, decoded="decoded").collect()
    assert _held(spark) > 0
    for _ in range(3):  # tasks are dealt to workers as it happens
        language.predict(docs, language.learn(docs)).collect()
        common.map_batches(docs, lambda: lambda batch: iter([batch]), docs.schema).repartition(16).collect()
        if not _held(spark):
            return
    raise AssertionError("workers still keep the encoder")


def test_parts_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"a": list(range(6)), "text": ["x" * 5, None, "y" * 30, "", "z" * 8, "u"]})
    parts = list(common.parts_of(batch, 1, 10))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5]]
    assert max(p.num_rows for p in common.parts_of(batch, 1, 1 << 20)) == 6


def test_ids_are_made_by_parts(spark, monkeypatch):
    texts = [f"bala {'bolu ' * (i % 7)}{i}" for i in range(40)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode(docs, decoded="decoded").collect()}
    monkeypatch.setattr(bpe, "PART", 50)
    assert {r.doc_id: (r.ids, r.decoded) for r in bpe.encode(docs, decoded="decoded").collect()} == whole
