"""Every stage of the pipeline on its own input, and on tables with nulls, repeats and nothing in them."""

import random

import pytest

import corpus_pipeline
from quillstack.llm import bpe, neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(1)
    sounds = {"aa": ["ba", "bo", "bi", "bu"], "bb": ["shu", "sha", "shi", "she"]}

    def text(lang, n):
        return " ".join("".join(rnd.choice(sounds[lang]) for _ in range(rnd.randrange(2, 7))) for _ in range(n))

    rows = [(i, text(lang, 60), lang, rnd.choice(["s", "t", None])) for i, lang in enumerate(["aa", "bb"] * 20)]
    passage = text("aa", 30)
    rows += [(100, rows[3][1], "bb", "s"), (101, None, "aa", "s"), (102, "12 34", None, "s"), (103, "", None, None)]
    rows += [(104, f"{text('aa', 70)} {passage}", "aa", "t"), (105, f"{passage} {text('aa', 80)}", None, "t"), (None, text("aa", 50), "aa", "s")]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x") for i, t, lang, s in rows], DOCS)


def test_language_keeps_clean_documents(spark, table):
    left = STAGES["language"](spark, table, "")
    assert left.columns == table.columns
    assert {r[0] for r in table.select("doc_id").collect()} - {r[0] for r in left.select("doc_id").collect()} == {101, 102, 103}


def test_near_duplicates_keep_one_of_a_class(spark, table):
    left = STAGES["near_duplicates"](spark, table, "")
    assert left.columns == table.columns and left.count() == table.count() - 1 and left.filter("doc_id = 100").isEmpty()
    kept = [t.split() for (t,) in left.filter("text <> ''").select("text").collect()]
    assert not any(neardup.similar(a, b) for i, a in enumerate(kept) for b in kept[:i] if min(len(a), len(b)) > 5)


def test_repeated_spans_go(spark, table):
    left = {r["doc_id"]: r for r in STAGES["repeated_spans"](spark, table, "").collect()}
    assert len(left) == table.count() and left[100]["text"] == "" and left[100]["n_chars"] == 0
    assert len(left[105]["text"].split()) == 80 and len(left[104]["text"].split()) == 100 and left[101]["text"] is None


def test_mixing_and_bpe(spark, table):
    mixed = STAGES["mixing"](spark, table, "")
    assert mixed.columns == table.columns and mixed.count() > 20
    coded = STAGES["bpe"](spark, mixed, "")
    assert coded.count() == mixed.count()
    encoder = bpe.Encoder(bpe.read_tokenizer(bpe.default_path()))
    texts = dict(map(tuple, table.select("doc_id", "text").collect()))
    assert all(r["n_tokens"] == len(encoder.encode(texts[r["doc_id"]] or "")) // 4 == len(r["ids"]) for r in coded.collect())


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, table, name):
    assert STAGES[name](spark, table.limit(0), "").count() == 0


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() > 100 and rows.filter("n_tokens IS NULL").isEmpty()
