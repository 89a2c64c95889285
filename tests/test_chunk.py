import random

import pytest
from pyspark.sql import functions as F

from quillstack.operators import chunk as ck


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_separator_stays_with_the_unit_before(spark):
    t = F.col("t")
    assert one(spark, "第一句。第二句。第三句。", ck.split_units(t, ["。"])) == ["第一句。", "第二句。", "第三句。"]
    assert one(spark, "aaa\n\nbbb\n\nccc", ck.split_units(t, ["\n\n"])) == ["aaa\n\n", "bbb\n\n", "ccc"]
    assert one(spark, "x y\nz", ck.split_units(t, [])) == ["x ", "y\n", "z"]
    assert one(spark, "a*b*c", ck.split_units(t, ["*"])) == ["a*", "b*", "c"]


def test_windows_put_together_give_the_text(spark):
    random.seed(3)
    rows = [("".join(random.choice("ab \né😀") for _ in range(random.randrange(0, 90))),) for _ in range(60)]
    df = spark.createDataFrame(rows, "t string")
    for size, overlap in [(1, 0), (7, 3), (10, 9), (20, 0), (13, 5), (5, 8)]:
        step = max(size - overlap, 1)
        for row in df.select("t", ck.char_windows(F.col("t"), size, overlap).alias("w")).collect():
            expected, start = [], 0
            while start < len(row.t):
                expected.append(row.t[start : start + size])
                if start + size >= len(row.t):
                    break
                start += step
            assert row.w == expected


def test_protected_regions_are_units(spark):
    text = "One. ```a. b\nc``` two. ![i. j](k l) and $x. y$ end. [a. b](c)[d](e. f) |"
    units = one(spark, text, ck.split_units_protected(F.col("t"), [". "]))
    assert units == [
        "One. ", "```a. b\nc```", " two. ", "![i. j](k l)", " and ", "$x. y$", " end. ", "[a. b](c)[d](e. f)", " |",
    ]
    # A link that begins inside a formula joins it into one region.
    crossing = "p. $a [x. $](y. z) q. r"
    assert one(spark, crossing, ck.split_units_protected(F.col("t"), [". "])) == ["p. ", "$a [x. $](y. z)", " q. ", "r"]
    table = "head. x\n| a. b | c. d |\nafter. z"
    assert one(spark, table, ck.split_units_protected(F.col("t"), [". "])) == ["head. ", "x", "\n| a. b | c. d |\n", "after. ", "z"]


def test_token_merge(spark):
    units = ["aaaa" * 3, "bbbb" * 4, "cccc" * 5, "dddd" * 9, "eeee"]
    df = spark.createDataFrame([(units,)], "u array<string>")
    out = df.select(ck.merge_by_tokens(F.col("u"), 8, 3).alias("m")).first()["m"]
    assert [(m["text"], m["first"]) for m in out] == [
        ("aaaa" * 3 + "bbbb" * 4, 0), ("cccc" * 5, 2), ("dddd" * 8, 3), ("dddd" * 4 + "eeee", 3),
    ]
    small = spark.createDataFrame([(["ab cd. "] * 12,)], "u array<string>")
    merged = small.select(ck.merge_by_tokens(F.col("u"), 3, 1).alias("m")).first()["m"]
    assert all(len(m["text"]) <= 25 for m in merged) and len(merged) > 3


def plain_merge(units, size, overlap, count):
    """The greedy merge written out."""
    overlap, pieces = min(max(overlap, 0), size - 1), []
    for position, unit in enumerate(units):
        if count(unit) <= size:
            pieces.append((unit, position))
        else:
            width, step = 4 * size, 4 * (size - overlap)
            starts = range(0, max(len(unit) - width, 0) + step, step)
            pieces += [(unit[s : s + width], position) for s in starts if unit[s : s + width].strip()]
    out, held, total = [], [], 0
    for text, position in pieces:
        need = count(text)
        if held and total + need > size:
            out.append(held)
            held = list(held)
            while held and (total > overlap or total + need > size):
                total -= count(held.pop(0)[0])
        held.append((text, position))
        total += need
    out += [held] if held else []
    joined = [("".join(t for t, _ in h).strip(), h[0][1]) for h in out]
    return [x for x in joined if x[0]]


@pytest.mark.parametrize("size,overlap", [(3, 1), (5, 4), (8, 0), (20, 50), (1, 0)])
def test_token_merge_against_a_plain_fold(spark, size, overlap):
    rnd = random.Random(size)
    rows = [(i, [rnd.choice("abc \u00e9") * rnd.randrange(0, 60) for _ in range(rnd.randrange(0, 30))]) for i in range(40)]
    rows = [(i, [u for u in units if u.strip()]) for i, units in rows] + [(99, [])]
    df = spark.createDataFrame(rows, "id int, u array<string>")
    for counter in (None, lambda text: len(text) // 3 + 1):
        made = df.select("id", ck.merge_by_tokens(F.col("u"), size, overlap, counter).alias("m")).collect()
        for r in made:
            units = dict(rows)[r["id"]]
            assert [(m["text"], m["first"]) for m in r["m"]] == plain_merge(units, size, overlap, counter or (lambda text: len(text) // 4))


def test_units_of_texts_with_control_characters(spark):
    """Units put together give the text, whatever control characters it holds; each ends with its first separator."""
    rnd, seps = random.Random(9), [". ", "\u0001", "\n", "]]", "]"]
    texts = ["".join(rnd.choice("ab. \n]\u0001\u0002\u0003\u0004\u0005\u0006\u0007$`|[(") for _ in range(rnd.randrange(0, 80))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for separators in (seps, [". "], ["\u0002", "aba", "ab"]):
        for r in df.select("t", ck.split_units(F.col("t"), separators).alias("u")).collect():
            want, at = [], 0
            while at < len(r.t):
                hits = [(r.t.find(s, at), n) for n, s in enumerate(separators) if r.t.find(s, at) >= 0]
                end = min(hits)[0] + len(separators[min(hits)[1]]) if hits else len(r.t)
                want.append(r.t[at:end])
                at = end
            assert r.u == [w for w in want if w.strip()]
    for r in df.select("t", ck.protected_segments(F.col("t")).alias("s")).collect():
        assert "".join(x["text"] for x in r.s) == r.t
    text = "a\u0001b. ```c\u0002. d\u0003``` e\u0004. f"
    assert one(spark, text, ck.split_units_protected(F.col("t"), [". "])) == ["a\u0001b. ", "```c\u0002. d\u0003```", " e\u0004. ", "f"]
    assert [x["text"] for x in one(spark, "x\u0001y\n# h\u0001\nz", ck.markdown_sections(F.col("t")))] == ["x\u0001y", "# h\u0001\nz"]


def test_units_of_a_long_text(spark):
    text = "x" * 200_000 + "." * 200_000 + ". " + "y" * 1000
    assert [len(u) for u in one(spark, text, ck.split_units(F.col("t"), [". "]))] == [400_002, 1000]


def test_markdown_headers(spark):
    text = "intro\n# One\nbody\r\n###### Six\n#no header\n## Two\nx\n"
    sections = one(spark, text, ck.markdown_sections(F.col("t")))
    assert [(s["header"], s["text"]) for s in sections] == [
        ("", "intro"), ("# One", "# One\nbody"), ("###### Six", "###### Six\n#no header"), ("## Two", "## Two\nx"),
    ]
    plain = spark.createDataFrame([(1, "no header here. at all")], "id int, text string")
    rows = ck.markdown_chunks(plain, ck.ChunkConfig(size=10, overlap=0)).collect()
    assert [r["section"] for r in rows] == [""] * len(rows) and rows[0]["text"] == "no header"


def test_media_context_uses_original_neighbours(spark):
    df = spark.createDataFrame([(["first text", "a\n| x | y |", "![p](q)", "last words"],)], "c array<string>")
    out = df.select(ck.attach_media_context(F.col("c"), 4, 3).alias("c")).first()["c"]
    assert out == ["first text", "text\n\na\n| x | y |\n\n![p]", "y |\n\n![p](q)\n\nlas", "last words"]


def test_bad_parameters():
    with pytest.raises(ValueError):
        ck.ChunkConfig(size=0)
    with pytest.raises(ValueError):
        ck.ChunkConfig(size=10, overlap=10)
    with pytest.raises(ValueError):
        ck.token_windows(F, 4, 4)
