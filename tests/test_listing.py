"""Hidden files, recursion and unreadable folders; registering what was found; tasks of an owner; promotion rules."""

import os

import pytest
from pyspark.sql import functions as F

from quillstack.operators import runlog as rl
from quillstack.operators import versions as ve
from quillstack.plans import search as plans
from quillstack.sources import files
from quillstack.sources.listing import list_folder


def names(frame):
    return sorted(r["name"] for r in frame.collect())


def test_hidden_names_and_recursion(spark, tmp_path):
    for path in ("a.txt", ".hidden.txt", "_data.txt", "sub/b.txt", "sub/.c.txt", "sub/deep/d.md", ".dir/e.txt"):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * len(path))
    (tmp_path / "empty").mkdir()
    root = str(tmp_path)
    assert names(list_folder(spark, root)) == ["a.txt", "b.txt", "d.md"]
    assert names(list_folder(spark, root, True)) == [".c.txt", ".hidden.txt", "_data.txt", "a.txt", "b.txt", "d.md", "e.txt"]
    assert names(list_folder(spark, root, True, recursive=False)) == [".hidden.txt", "_data.txt", "a.txt"]
    assert names(list_folder(spark, "file://" + root, glob="*.txt")) == ["a.txt", "b.txt"]
    rows = {r["name"]: r for r in files.list_files(spark, root, show_hidden=True).collect()}
    assert rows[".c.txt"]["size"] == len("sub/.c.txt") and rows[".c.txt"]["path"].endswith("/sub/.c.txt") and rows["a.txt"]["modified_at"]
    assert names(files.list_files(spark, root)) == ["a.txt", "b.txt", "d.md"]
    assert list_folder(spark, root, True).rdd.getNumPartitions() == 4
    if os.getuid():
        (tmp_path / "sub").chmod(0)
        assert names(list_folder(spark, root)) == ["a.txt"]
        (tmp_path / "sub").chmod(0o755)


def test_a_folder_that_cannot_be_read_is_left_out(spark, tmp_path):
    assert list_folder(spark, str(tmp_path / "absent"), True).count() == 0


def test_registering_twice_adds_nothing(spark):
    listing = spark.createDataFrame([("x/user_1/a.txt", 5), ("user_2/b/c.PDF", 6), ("shared/d.txt", 7), ("x/user_1/a.txt", 5)], "path string, size long")
    known = spark.createDataFrame([("user_2/b/c.PDF", "c.PDF", 2)], "path string, name string, user_id long")
    once = files.register_found(listing, known, F.timestamp_seconds(F.lit(0)))
    assert sorted((r["path"], r["name"], r["user_id"]) for r in once.collect()) == [("user_2/b/c.PDF", "c.PDF", 2), ("x/user_1/a.txt", "a.txt", 1)]
    assert files.register_found(listing, once, F.timestamp_seconds(F.lit(1))).count() == 2


def test_tasks_of_an_owner_and_a_mode(spark):
    tasks = spark.createDataFrame([(1, "t", 7, "fast"), (2, "t", 7, "slow"), (3, "t", 8, None), (4, "t", None, "fast")], "id long, title string, user_id long, mode string")
    ids = lambda **k: sorted(r["id"] for r in rl.filter_tasks(tasks, **k).collect())
    assert ids() == [1, 2, 3, 4] and ids(owner=7, is_admin=False) == [1, 2] and ids(is_admin=False) == []
    assert ids(mode="fast") == [1, 4] and ids(not_mode="fast") == [2] and ids(mode="slow", not_mode="slow") == [2]


def test_promotion_rules(spark):
    one = spark.createDataFrame([("c", 1, "h", "embed_m_h")], "collection string, doc_id long, technical_id string, semantic_id string")
    for step, kwargs in (("embed", {}), ("move", {}), ("parse", {"operator": "x" * 33}), ("parse", {})):
        with pytest.raises(ValueError):
            ve.promote({}, one, step, "c", 1, "absent" if step == "parse" else "h", F.current_timestamp(), **kwargs)


def test_search_falls_back_with_a_warning():
    config = plans.SearchConfig(kind="hybrid")
    assert plans.effective_kind(config, None, "x")[0] == "sparse" and plans.effective_kind(config, [1.0], "")[0] == "dense"
    assert plans.effective_kind(config, [1.0], "x") == ("hybrid", [])
    with pytest.raises(ValueError):
        plans.effective_kind(config, None, None)
