"""The live text index: batches against a scan of the live texts, phrases against brute force, early stop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstack.operators import textsearch as ts
from quillstack.operators.textindex import LiveTextIndex, parse_query
from quillstack.session import shared_dir


def corpus(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")


def text(rnd, n):
    return " ".join(f"w{min(int(rnd.expovariate(0.15)), 60)}" for _ in range(n))


def ranks(found):
    return [(r["doc_id"], round(r["bm25"], 6)) for r in found.collect()]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    return {i: text(rnd, rnd.choice([3, 20, 90])) for i in range(250)}


def test_search_after_each_change_equals_a_scan(spark, texts):
    rnd, live = random.Random(3), {}
    index = LiveTextIndex(spark, shared_dir(spark, "live"), ["doc_id"], buckets=4)
    batches = [
        {i: t for i, t in texts.items() if i < 150}, {i: t for i, t in texts.items() if i >= 150}, {i: text(rnd, 30) for i in range(0, 250, 9)},
        list(range(0, 250, 5)), "merge", {i: text(rnd, 8) for i in range(0, 60)} | {900: None, 901: ""}, [1, 2, 3, 5000],
    ]
    for batch in batches:
        if batch == "merge":
            index.merge()
        elif isinstance(batch, dict):
            index.upsert(corpus(spark, batch))
            live |= batch
        else:
            index.delete(spark.createDataFrame([(i,) for i in batch], "doc_id long"))
            live = {i: t for i, t in live.items() if i not in batch}
        _, _, docs, words = index.state()
        assert (docs, words) == (len(live), sum(len((t or "").split()) for t in live.values()))
        scan = {i: t or "" for i, t in live.items()}
        for query in ("w1 w40 w22", "w0"):
            assert ranks(index.search(query, 8)) == ranks(ts.bm25_scan(corpus(spark, scan), query, 8, ["doc_id"]))


def test_weak_terms_alone_are_not_scored(spark, texts):
    index = LiveTextIndex(spark, shared_dir(spark, "live"), ["doc_id"], buckets=4)
    index.upsert(corpus(spark, texts | {1000 + i: f"rare{i} " + "x " * 5 for i in range(5)}))
    query = "rare1 rare2 rare3 w0 w1"
    best, scored = index.ranked(query, 3)
    everything = ts.bm25_scan(corpus(spark, texts | {1000 + i: f"rare{i} " + "x " * 5 for i in range(5)}), query, 3, ["doc_id"])
    assert ranks(best) == ranks(everything)
    matching = index.live(["rare1", "rare2", "rare3", "w0", "w1"]).select("doc_id").distinct().count()
    assert scored.count() == 3 < matching


def test_phrases_against_brute_force(spark, texts):
    index = LiveTextIndex(spark, shared_dir(spark, "live"), ["doc_id"], buckets=4)
    index.upsert(corpus(spark, texts))
    for phrase in (["w1", "w2"], ["w0", "w0"], ["w0", "w0", "w0"], ["w3", "w1", "w0"], ["w7"], ["nothing", "here"]):
        counts = {}
        for i, t in texts.items():
            words = t.split()
            n = sum(words[j : j + len(phrase)] == phrase for j in range(len(words) - len(phrase) + 1))
            if n:
                counts[i] = n
        hits = index._phrase_hits([phrase], [])
        assert {r["doc_id"]: r["tf"] for r in hits.collect()} == counts
        assert set(r["doc_id"] for r in index.search(f'"{" ".join(phrase)}" w5', 999).collect()) == set(counts)
    both = index.search('"w1 w2" "w0 w1"', 999)
    pattern = lambda p: {i for i, t in texts.items() if re.search(rf"\b{p}\b", t)}
    assert {r["doc_id"] for r in both.collect()} == pattern("w1 w2") & pattern("w0 w1")


def test_queries_and_empty_index(spark):
    assert parse_query('"A b" c "d" "" e c') == ([["a", "b"], ["d"]], ["c", "e"])
    index = LiveTextIndex(spark, shared_dir(spark, "live"), ["doc_id"])
    with pytest.raises(FileNotFoundError):
        index.search("a", 3)
    index.upsert(corpus(spark, {1: "a b", 2: None}))
    assert index.search("zzz", 3).count() == 0 and index.search("", 3).count() == 0
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert index.search("a", 3).count() == 0
    assert index.live().count() == 0
    index.merge()
    assert index.state()[2:] == (1, 0)
    assert index.live().agg(F.count("*")).first()[0] == 0
