import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions.windows import previous_row, running_sum, salted_join
from quillstack.operators import runlog as rl
from quillstack.operators import textops as tx
from quillstack.operators import transcript as tr
from quillstack.operators import versions as ve


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_redaction(spark):
    t = F.col("t")
    assert value(spark, tx.redact(t), "token=abcdefghij x") == "token=***ghij x"
    assert value(spark, tx.redact(t), "API-KEY=12345678&a=1") == "API-KEY=***78&a=1"
    assert value(spark, tx.redact(t), "password=a") == "password=***a"
    text = "Authorization: Bearer abc.def.ghijk, X-Goog-Api-Key : secretkey1; x-api-key: ab"
    assert value(spark, tx.redact(t), text) == "Authorization: Bearer ***hijk, X-Goog-Api-Key : ***key1; x-api-key: ***ab"
    assert value(spark, tx.redact(t), "monkey=12 mytoken=3 nothing") == "monkey=12 mytoken=3 nothing"


def test_json_depth_and_kind(spark):
    cases = {
        '{"a":{"b":[1,{"c":2}]}}': ("object", 4), "[]": ("array", 0), '{"a":{}}': ("object", 1), '"a{[\\"{"': ("string", 0),
        "[[1],[[2]]]": ("array", 3), "12": ("number", 0), "true": ("boolean", 0), "{x": (None, None),
        '{"k":"' + '\\"' * 9000 + '"}': ("object", 1),
    }
    for text, expected in cases.items():
        assert (value(spark, tx.json_kind(F.col("t")), text), value(spark, tx.json_depth(F.col("t")), text)) == expected


def test_json_paths(spark):
    text = '{"segments":[{"text":"a","x":{"y":1}},{"text":null},{"other":2}],"title":"t","deep":[[{"v":5}],[{"v":[6,7]}]]}'

    def at(path):
        return value(spark, tx.json_path_values(F.col("t"), path), text)

    assert at("segments.text") == ['"a"', "null"] and at("segments.x.y") == ["1"]
    assert at("title") == ['"t"'] and at("deep.v") == ["5", "[6,7]"] and at("none.x") == []


def test_line_edits(spark):
    t, text = F.col("t"), "a\nb\nc"
    assert value(spark, tx.replace_lines(t, "X", number=3), text) == "a\nb\nX\n"
    assert value(spark, tx.replace_lines(t, "X", number=9), text) == text
    assert value(spark, tx.insert_lines(t, "X", number=1), text) == "X\na\nb\nc"
    assert value(spark, tx.insert_lines(t, "X", number=4), text) == "a\nb\ncX\n"
    assert value(spark, tx.insert_lines(t, "X", number=5), text) == text
    assert value(spark, tx.delete_lines(t, pattern="[ac]"), text) == "b\n"


def test_find_replace_literals(spark):
    new, n = tx.find_replace(F.col("t"), "a.b$", "$1\\", case_sensitive=False)
    assert value(spark, new, "A.B$ axb a.b$") == "$1\\ axb $1\\" and value(spark, n, "A.B$ axb a.b$") == 2


def test_timestamps(spark):
    good = ["2024-01-02", "2024-01-02T03", "2024-01-02 03:04", "2024-01-02T03:04:05.5", "2024-01-02T03:04:05+01:00", "2024-01-02T03Z"]
    for text in good:
        got = value(spark, F.unix_micros(tx.lenient_timestamp(F.col("t"))), text)
        want = datetime.datetime.fromisoformat(text)
        want = want if want.tzinfo else want.replace(tzinfo=datetime.timezone.utc)
        assert got == int(want.timestamp() * 1_000_000)
    for text in ["x", "2024-13-01", "02/01/2024", "2024-01-02T25:00", ""]:
        assert value(spark, tx.lenient_timestamp(F.col("t")), text) is None


def test_split_windows_equal_plain_windows(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("int")).otherwise((F.col("id") % 2).cast("int")).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(997)).alias("t"), "id",
    ).withColumn("b", F.floor(F.col("t") / 50))
    plain = W.partitionBy("k").orderBy("t", "id")
    expected = {r.id: (r.s, r.p) for r in rows.select(
        "id", F.sum("t").over(plain.rowsBetween(W.unboundedPreceding, 0)).alias("s"), F.lag("id").over(plain).alias("p")
    ).collect()}
    summed = running_sum(rows, ["k"], [F.col("t"), F.col("id")], "b", F.col("t"), "s").select("id", "s")
    lagged = previous_row(rows, ["k"], ["t", "id"], "b", ["id"]).select("id", F.col("prev_id").alias("p"))
    assert {r.id: (r.s, r.p) for r in summed.join(lagged, "id").collect()} == expected
    down = W.partitionBy("k").orderBy(F.col("t").desc(), F.col("id").desc()).rowsBetween(W.unboundedPreceding, 0)
    want = {r.id: r.s for r in rows.select("id", F.sum("t").over(down).alias("s")).collect()}
    got = running_sum(rows, ["k"], [F.col("t").desc(), F.col("id").desc()], "b", F.col("t"), "s", descending=True)
    assert {r.id: r.s for r in got.collect()} == want


def test_salted_join_equals_join(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50).alias("k"))
    unique = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, salted_join(rows, unique, ["k"], how=how).select("k", "id", *(["v"] if how in ("inner", "left") else [])).collect()))
        b = sorted(map(str, rows.join(unique, ["k"], how).select("k", "id", *(["v"] if how in ("inner", "left") else [])).collect()))
        assert a == b


def test_segment_merge(spark):
    rows = [
        (1, 0, 0.0, 1.0, "a", "one", 0.8), (1, 1, 1.5, 2.0, "a", "two", None), (1, 2, 2.5, 3.0, "a", "three", 0.4),
        (1, 3, 5.0, 6.0, "a", "four", None), (1, 4, 6.1, 7.0, "b", "five", 0.5), (1, 5, 7.0, 8.0, "a", "six", 0.1),
    ]
    df = spark.createDataFrame(rows, "k int, order int, start double, end double, speaker string, text string, confidence double")
    for width in (86_400.0, 2.0):
        out = rl.merge_segments(df, ["k"], 1.0, width).orderBy("island").collect()
        assert [(r.speaker, r.start, r.end, r.text, r.segments) for r in out] == [
            ("a", 0.0, 3.0, "one two three", 3), ("a", 5.0, 6.0, "four", 1), ("b", 6.1, 7.0, "five", 1), ("a", 7.0, 8.0, "six", 1),
        ]
        assert abs(out[0].confidence - 0.6) < 1e-9 and out[1].confidence is None


def test_budget_and_truncation(spark):
    rows = [(1, t, "system" if t in (0, 5) else "user", "x" * 40) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert sorted(r.turn for r in tr.truncate_messages(df, 4).collect()) == [0, 5, 10, 11]
    assert sorted(r.turn for r in tr.truncate_messages(df, 1).collect()) == [0, 5]
    assert sorted(r.turn for r in tr.fit_to_budget(df, 55, 2).collect()) == [0, 5, 9, 10, 11]


def test_whole_transcripts_and_marks(spark):
    df = spark.createDataFrame([("c", t, "user", f"m{t}") for t in range(300)], "conv_id string, turn int, role string, text string")
    text = tr.rendered_transcript(df).first()["transcript"]
    assert text.split("\n") == [f"USER: m{t}" for t in range(300)]
    marks = spark.createDataFrame([("c", 7), ("c", 3), ("c", 900), ("d", 1)], "conv_id string, before int")
    assert sorted(r.turn for r in tr.messages_before(df, marks).collect()) == list(range(7))


def test_lists_are_whole_without_a_limit(spark):
    made = spark.range(150).select(
        F.lit("c").alias("collection"), F.col("id").cast("string").alias("doc_id"), F.lit("parse").alias("step_type"), F.lit("").alias("model_tag"),
        F.lit("t").alias("technical_id"), F.timestamp_seconds("id").alias("updated_at"), F.timestamp_seconds("id").alias("created_at"),
    )
    assert ve.list_candidates(made, "created_at").count() == 150
    assert ve.list_candidates(made, "created_at", limit=0).count() == 150
    assert ve.list_candidates(made, "created_at", limit=20).count() == 20
    assert ve.list_pointers(made, "c").count() == 150
    assert ve.list_pointers(made, "c", 10).count() == 10


def test_tokens_and_latency(spark):
    cases = {'{"total_tokens":5}': 5, '{"usage":{"total_tokens":7}}': 7, '{"prompt_tokens":1,"completion_tokens":2}': 3,
             '{"prompt_tokens":4}': 4, '{"total_tokens":"9"}': None, '{"total_tokens":1.5}': None, "{": None}
    for text, expected in cases.items():
        assert value(spark, rl.total_tokens(F.col("t")), text) == expected
    none = spark.createDataFrame([], "event_id int, event_type string, ts timestamp, task_id int, step int")
    out = rl.mean_latency(rl.paired_latency(none, ["a"], ["b"], ["task_id", "step"])).first()
    assert out.pairs == 0 and out.mean_seconds is None
