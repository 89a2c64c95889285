"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quillstack.llm import bpe, fingerprint, language, mixing, neardup, quotes, rollups, spans, topk, urls
from quillstack.llm.queries import prepared
from quillstack.session import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, row string, words long, size long"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    prepared(spark)
    full = [(i, t, lang, source, len(t or ""), "x", "y", 7, 8) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


def words(rnd, n, kinds=400):
    return " ".join(f"w{rnd.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    base = [words(rnd, n) for n in (3, 19, 20, 21, 60, 200, 400, 3000)]
    passage = words(rnd, 55)
    rows = [*base, base[4], base[4], base[5].replace(" ", "\n", 3), None, "", " \t\n", "a " * 300, "...", "\x1f \u2003 é"]
    edited = base[6].split()
    for at in (10, 100, 250):
        edited[at] = "changed"
    rows += [" ".join(edited), f"{words(rnd, 40)} {passage} {words(rnd, 9)}", f"{passage} {words(rnd, 30)}", f"{words(rnd, 5)} {passage}"]
    return [(i * 3 + 1, t, "en", f"s{i % 4}" if i % 5 else None) for i, t in enumerate(rows)]


# 1


def test_edit_distance():
    rnd = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(3000):
        a = [rnd.randrange(rnd.choice([2, 9])) for _ in range(rnd.randrange(25))]
        b = [x for x in a if rnd.random() > 0.1] + [rnd.randrange(9) for _ in range(rnd.randrange(4))]
        most, right = rnd.randrange(10), plain(a, b)
        assert neardup.edits_within(a, b, most) == (right if right <= most else None)


def test_classes_brute_force(spark, corpus):
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, corpus)).collect()}
    texts = {i: (t or "").encode().split() for i, t, _, _ in corpus}
    root = {i: i for i in texts}

    def top(i):
        return i if root[i] == i else top(root[i])

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if texts[i] and (texts[i] == texts[j] or min(len(texts[i]), len(texts[j])) > 5 and neardup.similar(texts[i], texts[j])):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert found == {i: top(i) for i in ids}
    assert len(set(found.values())) < len(found)


def test_classes_corners(spark):
    text = words(random.Random(2), 80)
    rows = [(1, text, None, None), (1, text, None, None), (None, text, None, None), (5, text, None, None), (9, None, None, None)]
    found = sorted(neardup.classes(docs(spark, rows)).collect(), key=str)
    assert sorted((r[0] or 0, r[1] or 0) for r in found) == [(0, 0), (1, 1), (1, 1), (5, 1), (9, 9)]
    assert neardup.classes(docs(spark, [])).count() == 0


def test_classes_of_form_letters(spark):
    """Unlike texts that share a long passage; a few pairs of them differ by edits in their own part."""
    rnd = random.Random(12)
    passage = words(rnd, 150).split()
    rows = [passage + [f"u{rnd.randrange(4000)}" for _ in range(50)] for _ in range(120)]
    for i in range(6):
        changed = list(rows[i])
        for at in rnd.sample(range(150, 200), 10):
            changed[at] = f"new{i}_{at}"
        rows.append(changed)
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [(i, " ".join(w), None, None) for i, w in enumerate(rows)])).collect()}
    assert [found[120 + i] for i in range(6)] == list(range(6))
    assert all(found[i] == i for i in range(120))


def test_form_letters_are_not_compared_with_each_other(spark, monkeypatch):
    """Unlike texts with three quarters in common: candidates grow with the texts, not with their pairs."""
    seen, linked = [], neardup.linked

    def counting(pairs, texts):
        seen[-1] += pairs.count()
        return linked(pairs, texts)

    monkeypatch.setattr(neardup, "linked", counting)
    for n in (400, 800):
        rnd = random.Random(n)
        passage = words(rnd, 150)
        rows = [(i, f"{passage} {' '.join(f'u{rnd.randrange(10**9)}' for _ in range(50))}", None, None) for i in range(n)]
        seen.append(0)
        assert {r["class_id"] for r in neardup.classes(docs(spark, rows)).collect()} == set(range(n))
    # Each bucket of a sketch compares its members with one of them, at most 32 for each text.
    assert seen[0] <= 32 * 400 and seen[1] <= 32 * 800 and seen[1] < 2.5 * seen[0]


def test_classes_with_a_large_class_and_texts_near_some_of_it(spark, monkeypatch):
    """Lists of members, larger than one list, and texts that ask by single words give the classes of all pairs."""
    rnd, rows = random.Random(21), []
    base = words(rnd, 60, 3000).split()
    for i in range(90):
        changed = list(base)
        for at in rnd.sample(range(60), rnd.choice([1, 3, 12, 16])):
            changed[at] = f"n{rnd.randrange(40)}"
        rows.append(changed)
    monkeypatch.setattr(neardup, "LISTED", 7)
    ids = range(len(rows))
    root = {i: i for i in ids}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in ids:
        for j in range(i):
            if neardup.similar(rows[i], rows[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    for busy in (0, 10**6):
        monkeypatch.setattr(neardup, "BUSY", busy)
        found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [(i, " ".join(w), None, None) for i, w in enumerate(rows)])).collect()}
        assert found == {i: top(i) for i in ids}


def test_texts_with_own_runs_do_not_meet_by_chance(spark, monkeypatch):
    """Unlike texts of few words share many pairs of words; only those too like others for their own runs to tell apart meet."""
    rnd, seen, apart = random.Random(31), [], neardup.apart
    rows = [words(rnd, 150, 300).split() for _ in range(200)]
    passage = words(rnd, 120, 300).split()
    rows += [passage + words(rnd, 30, 300).split() for _ in range(2)]

    def counting(members, asking, run, *more):
        seen.extend(r[0] for r in members.select("rep").distinct().collect())
        return apart(members, asking, run, *more)

    monkeypatch.setattr(neardup, "apart", counting)
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [(i, " ".join(w), None, None) for i, w in enumerate(rows)])).collect()}
    assert found == {i: 200 if i == 201 else i for i in range(202)}
    assert len(set(seen) - {200, 201}) <= 20


def test_a_text_may_be_left_for_the_role_of_the_shorter_one_only(spark):
    """Its runs of three stand in another text, its runs of four do not: too many edits for the longer text of a pair."""
    one = [f"w{i}" for i in range(200)]
    other = [w for i in range(198) for w in [*one[i : i + 3], f"f{i}", f"g{i}"]]
    rows = spark.createDataFrame([(0, 0, 3, " ".join(one)), (1, 1, 3, " ".join(other))], "doc long, class long, role int, text string")
    marks = [neardup.bitmap_of_parts(neardup.shared_between_classes(rows, 4, 1, neardup.FINER), 4)]
    left = neardup.not_alone(rows, marks, 4, neardup.FINER).select("doc", "class", "role", "text").collect()
    assert [(r["doc"], r["role"], r["text"]) for r in left] == [(0, neardup.SHORTER, " ".join(one))]
    # Only longer texts count for it: another that is a shorter one at most does not.
    again = spark.createDataFrame([(0, 0, neardup.SHORTER, " ".join(one)), (1, 1, neardup.SHORTER, " ".join(one[::-1]))], rows.schema)
    shared = neardup.shared_between_classes(again, 4, 1, neardup.FINER)
    marks = [neardup.bitmap_of_parts(shared, 4, role) for role in (neardup.LONGER, neardup.SHORTER)]
    assert neardup.not_alone(again, marks, 4, neardup.FINER).count() == 0


def test_classes_at_the_threshold(spark):
    """Pairs of edit similarity 0.8 to 0.9, edits at random places and evenly spread, 5 to 300 words: all are found."""
    rnd, rows, pairs = random.Random(13), [], []
    for n in (5, 6, 8, 10, 15, 20, 40, 300):
        for edits in sorted({max(1, n // 10), n * 3 // 20, n // 5} - {0}):
            for even in (True, False) * 3:
                text = words(rnd, n, 5000).split()
                changed = list(text)
                for k, at in enumerate(range(n // edits // 2, n, n // edits) if even else rnd.sample(range(n), edits)):
                    if k < edits:
                        changed[at] = f"new{len(rows)}"
                pairs.append((len(rows), len(rows) + 1))
                rows += [text, changed]
    assert all(neardup.similar(rows[a], rows[b]) for a, b in pairs)
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, [(i, " ".join(w), None, None) for i, w in enumerate(rows)])).collect()}
    assert [(a, b) for a, b in pairs if found[a] != found[b]] == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    found = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 160)} == {100}


# 2


def test_rollups(spark):
    schema = "op string, source string, lang string, tokenizer string, tokens long, was_tokens long, docs string"

    def batch(*rows):
        return spark.createDataFrame([(*r, "other") for r in rows], schema)

    table = rollups.Rollups(spark, shared_dir(spark, "test-rollups"))
    first = batch(("insert", "a", "en", "t1", 5, None), ("insert", "a", "en", "t1", 5, None), ("insert", None, None, "t1", None, None), ("insert", "b", "de", "t1", 4, None))
    assert table.commit("1", first) and not table.commit("1", first)
    assert table.commit("2", batch(("revise", "a", "en", "t1", 9, 5), ("delete", "b", "de", "t1", 4, None)))
    assert table.commit("3", batch())
    want = {("a", "en", "t1", 2, 14), (None, None, "t1", 1, 0)}
    assert set(map(tuple, table.totals().collect())) == want
    table.compact()
    assert not table.commit("2", first)
    assert table.commit("4", batch(("insert", "c", "fr", "t2", 1, None)))
    assert set(map(tuple, table.totals().collect())) == want | {("c", "fr", "t2", 1, 1)}
    assert table.batches() == ["1", "2", "3", "4"]
    with pytest.raises(Exception, match="unknown op"):
        table.commit("5", batch(("update", "a", "en", "t1", 1, 1)))
    assert table.commit("5", batch(("insert", "a", "en", "t1", 1, None)))


# 3


def test_fingerprints_brute_force(spark, corpus):
    rows = docs(spark, corpus).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = fingerprint.with_next(rows, "doc_id", ["text"]).withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text")))
    a, b = fingerprint.sketch(F.col("text")), fingerprint.sketch(F.col("edited"))
    led = led.select("doc_id", "text", "next_text", "edited", a.alias("a"), b.alias("b"))
    led = led.withColumn("near", fingerprint.resemblance(F.col("a"), F.col("b"))).withColumn("n", fingerprint.distinct_shingles(F.col("a")))
    led = led.withColumn("part", fingerprint.containment(F.col("a"), F.col("b")))
    ordered = sorted((i, t or "") for i, t, _, _ in corpus)
    following = {i: ordered[(n + 1) % len(ordered)][1] for n, (i, _) in enumerate(ordered)}

    def shingles(t):
        w = t.encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    found = led.collect()
    assert len(found) == len(ordered)
    for r in found:
        assert r["next_text"] == following[r["doc_id"]]
        half = len(r["text"]) // 2
        assert r["edited"] == r["text"][: len(r["text"]) - half] + r["next_text"][:half]
        x, y = shingles(r["text"]), shingles(r["edited"])
        assert len(r["a"]) == min(128, len(x))
        assert abs(r["near"] - (len(x & y) / len(x | y) if x | y else 1)) < (0.15 if len(x | y) > 64 else 1e-9)
        assert abs(r["n"] - len(x)) <= (0 if len(x) < 128 else 0.35 * len(x))
        assert abs(r["part"] - (len(x & y) / len(x) if x else 1)) < 0.25


def test_fingerprints_merge(spark):
    rnd = random.Random(3)
    parts = [(k, words(rnd, 300)) for k in ("a", "a", "a", "b")]
    rows = spark.createDataFrame(parts, "k string, text string").select("k", fingerprint.sketch(F.col("text")).alias("s"))
    merged = {r[0]: r[1] for r in fingerprint.merge_parts(rows, "k", "s").collect()}
    hashes = [h for r in rows.filter("k = 'a'").collect() for h in r["s"]]
    assert merged["a"] == sorted(set(hashes))[:128] and len(merged["b"]) == 128


def test_next_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(None, "n"), (2, "b"), (2, "a"), (7, "z"), (1, "f")], "doc_id long, text string")
    led = {(r[0], r[1]): r[2] for r in fingerprint.with_next(rows, "doc_id", ["text"]).collect()}
    assert led == {(1, "f"): "a", (2, "a"): "b", (2, "b"): "z", (7, "z"): "n", (None, "n"): "f"}
    assert fingerprint.with_next(rows.limit(0), "doc_id", ["text"]).count() == 0


# 4


def test_url_rules(spark):
    cases = {
        "http://A.Example.COM/en/1?x": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "x://b.www.example.com/en/#t": ("b.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://k.net/es/://q": ("k.net", "/es/://q", "net/es/", "block"),
        "http://spam-farm.org/?": ("spam-farm.org", "/", None, "block"),
        "no scheme com/": ("", "", None, "allow"), None: ("", "", None, "allow"), "://": ("", "", None, "allow"),
    }
    rows = [(i, u, "<p>spam farm</p>" if i % 2 else None, "h") for i, u in enumerate(cases)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, host string")
    found = urls.judge(pages).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[list(cases)[r["page_id"]]]
    assert urls.judge(pages.limit(0)).count() == 0


def test_a_repeated_token_counts_each_time(spark):
    """Multinomial: of two words with opposite odds, the one that a url repeats decides."""
    ruled = [(i, f"http://a.example.com/en/{'red' if i % 2 else 'grey'}") for i in range(40)] + [(100 + i, f"http://b.com/{'blue' if i % 2 else 'grey'}") for i in range(40)]
    asked = [(200, "http://x.org/red/blue/blue/blue"), (201, "http://x.org/blue/red/red/red"), (202, "http://x.org/red/blue")]
    rows = [(i, u, None, "h") for i, u in [*ruled, *asked]]
    found = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert found[200]["words"].count("blue") == 3
    assert (found[200]["verdict"], found[201]["verdict"]) == ("allow", "block")
    # Scores are sums over the tokens: two more of each word move the score alike.
    blue, red = found[200]["score"] - found[202]["score"], found[201]["score"] - found[202]["score"]
    assert blue < -1 and red > 1


def test_segmentation():
    counts = {"water": 50, "law": 40, "la": 30, "w": 5, "waterlaw": 0}
    assert urls.segment("waterlaw", counts, 200) == ["water", "law"]
    assert urls.segment("", counts, 200) == []

    def every(s):
        return [[]] if not s else [[s[:i], *rest] for i in range(1, len(s) + 1) for rest in every(s[i:])]

    def score(split):
        return sum(math.log(counts[w] / 200) if counts.get(w) else math.log(10 / 200) - len(w) * math.log(10) for w in split)

    for name in ("lawater", "wlawxla", "waterw"):
        assert math.isclose(score(urls.segment(name, counts, 200)), max(map(score, every(name))))


# 5


def test_languages(spark):
    rnd = random.Random(4)
    sounds = {"aa": ["ba", "bo", "bi"], "bb": ["shu", "sha", "shi"], "cc": ["kre", "kra", "kro"]}

    def text(lang, n):
        return " ".join("".join(rnd.choice(sounds[lang]) for _ in range(rnd.randrange(2, 5))) for _ in range(n))

    rows = [(i, text(lang, 40), lang, "s") for i, lang in enumerate(list(sounds) * 30)]
    profiles = language.learn(docs(spark, [*rows, (900, None, "aa", "s"), (901, "x", None, "s")]))
    assert profiles.languages == ["aa", "bb", "cc"]
    mixed = f"{text('aa', 60)} {text('bb', 30)}"
    asked = [(1, text("bb", 5), None, None), (2, mixed.upper(), None, None), (3, None, None, None), (4, "12 .. \n", None, None), (5, text("cc", 400_000), None, None)]
    found = {r["doc_id"]: r for r in language.predict(docs(spark, asked).withColumn("score", F.lit("x")), profiles).collect()}
    assert (found[1]["lang_pred"], found[1]["languages"]) == ("bb", ["bb"])
    assert found[2]["languages"] == ["aa", "bb"] and abs(found[2]["score"] - 2 / 3) < 0.03
    assert all((found[i]["lang_pred"], found[i]["score"], found[i]["languages"]) == ("und", 0.0, []) for i in (3, 4))
    assert found[5]["lang_pred"] == "cc" and found[5]["score"] > 0.99
    empty = language.learn(docs(spark, []))
    assert [r["lang_pred"] for r in language.predict(docs(spark, asked), empty).collect()] == ["und"] * 5


def test_a_small_share_of_a_long_text(spark):
    """A hundredth of a long text in another language outweighs the penalty; a single odd word does not."""
    rnd = random.Random(6)
    sounds = {"aa": ["ba", "bo", "bi"], "bb": ["shu", "sha", "shi"]}

    def text(lang, n):
        return " ".join("".join(rnd.choice(sounds[lang]) for _ in range(rnd.randrange(2, 5))) for _ in range(n))

    profiles = language.learn(docs(spark, [(i, text(lang, 40), lang, "s") for i, lang in enumerate(list(sounds) * 30)]))
    asked = [(1, f"{text('aa', 9900)} {text('bb', 100)}", None, None), (2, f"{text('aa', 300)} {text('bb', 1)}", None, None)]
    found = {r["doc_id"]: r for r in language.predict(docs(spark, asked), profiles).collect()}
    assert found[1]["languages"] == ["aa", "bb"] and abs(found[1]["shares"][1] - 0.01) < 0.005
    assert found[2]["languages"] == ["aa"]


def test_mixtures_against_plain_em():
    """Chosen set and shares against expectation-maximisation written out, over all sets of languages."""
    import itertools

    import numpy as np

    rnd = np.random.default_rng(3)

    def plain(logs, chosen, rounds):
        share = {c: 1 / len(chosen) for c in chosen}
        for _ in range(rounds):
            parts = [{c: share[c] * math.exp(row[c]) for c in chosen} for row in logs]
            share = {c: sum(p[c] / sum(p.values()) for p in parts) / len(logs) for c in chosen}
        return share, sum(math.log(sum(share[c] * math.exp(row[c]) for c in chosen)) for row in logs)

    sizes, logs, want = [], [], []
    for shares in ([1, 0, 0], [0.7, 0.3, 0], [0.4, 0.3, 0.3], [0, 0.9, 0.1]):
        n = 200
        lang = rnd.choice(3, size=n, p=shares)
        rows = rnd.normal(-8, 1, (n, 3))
        rows[np.arange(n), lang] += 6
        best = max(
            (plain(rows, c, 200)[1] - (len(c) - 1) / 2 * math.log(n), c) for k in (1, 2, 3) for c in itertools.combinations(range(3), k)
        )[1]
        want.append((best, plain(rows, best, 200)[0]))
        sizes.append(n)
        logs.append(rows)
    found, size = language.mixtures(np.concatenate(logs).astype(np.float32), np.array(sizes))
    for row, m, (best, share) in zip(found, size, want):
        assert set(np.flatnonzero(row)) == set(best) and m == len(best)
        assert all(abs(row[c] - share[c]) < 0.03 for c in best)


# 6


def test_spans_brute_force(spark, corpus):
    rows = docs(spark, [*corpus, (None, corpus[4][1], "en", "s")])
    cut = spans.repeated_spans(rows)
    found = spans.remove_spans(rows, cut).collect()
    seen, want, texts = set(), {None: (corpus[4][1], 60, 0)}, {}
    for i, t, _, _ in sorted(corpus, key=lambda r: r[0]):
        w = texts[i] = [x.decode() for x in (t or "").encode().split()]
        gone = set()
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone.update(range(p, p + 20))
            seen.add(key)
        want[i] = (None if t is None else " ".join(x for n, x in enumerate(w) if n not in gone), len(w), len(gone))
    assert {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in found} == want
    assert all(r["words"] == 7 and r["doc"] == "x" for r in found)
    listed = cut.collect()
    assert listed
    for r in listed:
        n = r["n"] + 19
        assert texts[r["doc"]][r["at"] : r["at"] + n] == texts[r["source"]][r["source_at"] : r["source_at"] + n]
        assert (r["source"], r["source_at"]) < (r["doc"], r["at"])
    assert spans.remove_spans(rows.limit(0), spans.repeated_spans(rows.limit(0))).count() == 0


def test_spans_where_paths_branch(spark):
    """A passage between different words: its windows are resolved one by one, and the spans' words read at both places."""
    passage = [f"p{i}" for i in range(30)]
    texts = {1: [f"a{i}" for i in range(9)] + passage + [f"b{i}" for i in range(9)], 2: [f"c{i}" for i in range(5)] + passage + [f"d{i}" for i in range(5)], 3: [f"e{i}" for i in range(40)]}
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    cut = spans.repeated_spans(rows)
    assert [tuple(r) for r in cut.collect()] == [(2, 5, 11, 1, 9)]
    left = {r["doc_id"]: (r["n_removed"], r["text"]) for r in spans.remove_spans(rows, cut).collect()}
    assert left == {i: (30 * (i == 2), " ".join(w for w in words if i != 2 or w[0] != "p")) for i, words in texts.items()}


def test_a_hash_clash_is_no_repeat(spark, monkeypatch):
    """With word hashes that clash all the time, words at the source decide: nothing that does not repeat is removed."""
    rnd = random.Random(17)
    texts = [words(rnd, 60, 5000) for _ in range(6)]
    texts.append(f"{words(rnd, 10)} {' '.join(texts[0].split()[:30])}")
    plain = spans.Words.__init__

    def weak(self, column):
        plain(self, column)
        self.hashes = self.hashes * 0 + spans.U64(7)

    class Weak(spans.Words):
        __init__ = weak

    monkeypatch.setattr(spans, "Words", Weak)
    rows = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for r in spans.repeated_spans(rows).collect():
        n = r["n"] + 19
        own, source = texts[r["doc"]].split(), texts[r["source"]].split()
        assert own[r["at"] : r["at"] + n] == source[r["source_at"] : r["source_at"] + n]


# 7


def test_bpe_equals_the_library(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rnd = random.Random(6)
    odd = "aAbsStTdDlLvVrReE''''  \n\t\u0085\x1c0123٣Ⅷ½éÉẞΣσςİı中文한국😀👍🏽_-.,!?<|>/wwа\u200b\u0301\ufeff"
    texts = [t for _, t, _, _ in corpus] + ["".join(rnd.choice(odd) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    texts += ["a<|endoftext|>b <|startoftext|><|endoftext|>", "ha" * 5000, "ΟΔΥΣΣΕΥΣ Σ", "e\u0301 x"]
    rows = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]).withColumn("ids", F.lit("clash"))
    found = bpe.decode(bpe.encode(rows)).collect()
    assert len(found) == len(texts)
    for r in found:
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(rows.limit(0))).count() == 0


# 8


def test_quotes(spark):
    rows = [
        ("c", 1, "Hello there\nHow are you?"), ("c", 2, "> Hello  THERE\n> how are you?\nFine."), ("c", 3, ">> hello there\n> fine.\n\nGood\n"),
        ("c", 4, "> never said\nHm"), ("c", 5, "> Good\n> Hm\n> hello there\nThat"), ("d", 2, "> Hello there\nother conversation"),
        ("c", 2, "> Hello there\nFine."), (None, 1, "> Good\nx"), ("c", None, "> Good\ny"), ("e", 1, None), ("e", 2, ""), ("e", 3, "> > \n>"),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id string, turn long, text string, root string")
    found = quotes.link_quotes(table).collect()
    assert len(found) == len(rows)
    got = {(r["conv_id"], r["turn"], r["body"]): (r["reply_to"], r["root"], r["depth"]) for r in found}
    assert got["c", 2, "Fine."] == (1, 1, 1) and got["c", 3, "Good"] == (2, 1, 2) and got["c", 4, "Hm"] == (None, 4, 0)
    # One line each from three messages: the latest.
    assert got["c", 5, "That"] == (4, 4, 1) and got["d", 2, "other conversation"] == (None, 2, 0)
    assert got[None, 1, "x"] == (None, 1, 0) and got["c", None, "y"] == (None, None, 0) and got["e", 3, ""] == (None, 3, 0)
    assert quotes.link_quotes(table.limit(0)).count() == 0


def test_quotes_of_recurring_lines(spark):
    rows = [
        (1, "Yes."), (2, "Which one?\nThe red one"), (5, "Yes."), (6, "> Yes.\nFine"), (300, "> yes.\nLate"),
        (301, "Which one?\nThe blue one"), (302, "> Which one?\n> The red one\nThat"), (303, "> which one? the\n> blue one\nWrapped"), (304, "> Late\n> Yes.\nTwo"),
    ]
    found = quotes.link_quotes(spark.createDataFrame([("c", *r) for r in rows], "conv_id string, turn long, text string")).collect()
    got = {r["turn"]: r["reply_to"] for r in found}
    assert got == {1: None, 2: None, 5: None, 6: 5, 300: 5, 301: None, 302: 2, 303: 301, 304: 300}


def test_quotes_between_replies(spark):
    """Quote, reply, wrapped quote, reply: every run finds its own origin."""
    rows = [
        (1, "Shall we meet at noon"), (2, "The red door\nis open all day"), (3, "> Shall we meet at noon\nYes\n\n> The red door is\n> open all day\nGood"),
        (4, "> Good\n>> The red door is\n>> open all day\nFine"), (5, "> Yes\n> Good\nBoth"),
    ]
    found = quotes.link_quotes(spark.createDataFrame([("c", *r) for r in rows], "conv_id string, turn long, text string"))
    got = {r["turn"]: r for r in found.collect()}
    assert got[3]["answers"] == [1, 2] and got[3]["reply_to"] == 2 and got[3]["body"] == "Yes\n\nGood"
    assert got[4]["answers"] == [3] and got[5]["reply_to"] == 3 and (got[5]["root"], got[5]["depth"]) == (2, 2)
    threads = {r["root"]: [m["turn"] for m in r["messages"]] for r in quotes.conversations(found).collect()}
    assert threads == {1: [1], 2: [2, 3, 4, 5]}


def test_quotes_against_brute_force(spark):
    """Random conversations: the origin with most votes, found by looking at all earlier messages."""
    rnd, rows = random.Random(31), []
    for turn in range(60):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            if turn and rnd.random() < 0.6:
                own = [x for x in rnd.choice(rows)[1].split("\n") if not x.startswith(">")]
                text = " ".join(own) if rnd.random() < 0.5 else "\n".join(own)
                words_ = text.split(" ")
                cut = rnd.randrange(1, len(words_) + 1)
                parts += [f"> {x}" for x in (" ".join(words_[:cut]) + "\n" + " ".join(words_[cut:])).split("\n") if x]
            parts.append(" ".join(f"w{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 5))))
        rows.append((turn, "\n".join(parts)))

    def runs(text):
        out = []
        for line in text.split("\n"):
            level, norm = int(line.startswith(">")), " ".join(line.lstrip("> ").lower().split())
            if out and out[-1][0] == level:
                out[-1][1].append(norm)
            else:
                out.append((level, [norm]))
        return out

    want = {}
    for turn, text in rows:
        votes = {}
        for level, lines in runs(text):
            if level:
                for passage, n in [((x,), 1) for x in lines] + [(" ".join(lines), len(lines))]:
                    origin = None
                    for earlier, other in rows[:turn]:
                        own = [r for lev, r in runs(other) if lev == 0]
                        whole = [" ".join(x) for x in own] + [" ".join(" ".join(x) for x in own)]
                        if passage in whole if isinstance(passage, str) else any(passage[0] in x for x in own):
                            origin = earlier
                    if origin is not None:
                        votes[origin] = votes.get(origin, 0) + n
        want[turn] = max(votes, key=lambda o: (votes[o], o)) if votes else None
    found = quotes.link_quotes(spark.createDataFrame([("c", *r) for r in rows], "conv_id string, turn long, text string")).collect()
    assert {r["turn"]: r["reply_to"] for r in found} == want and any(v is not None for v in want.values())


def test_long_reply_chain(spark):
    rows = [("c", i, f"> line {i - 1}\nline {i}" if i else "line 0") for i in range(60)]
    found = quotes.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, text string")).collect()
    assert {(r["turn"], r["root"], r["depth"]) for r in found} == {(i, 0, i) for i in range(60)}


# 9


def test_targets():
    assert mixing.source_targets({"b": 100, "a": 100, None: 100}) == {"a": 187.5, "b": 75.0, None: 37.5}
    assert mixing.source_targets({"a": 10, "b": 90, "c": 0}) == {"a": 30.0, "b": 70.0, "c": 0.0}
    assert mixing.source_targets({}) == {}


def test_quotas():
    table = mixing.split_quotas([17, 0, 500, 3], 5, 1)
    assert table.sum(0).tolist() == [17, 0, 500, 3] and set(table.sum(1)) == {104}
    assert (table >= 0).all() and (table == mixing.split_quotas([17, 0, 500, 3], 5, 1)).all()


def test_mix(spark):
    rnd = random.Random(8)
    rows = [(i, words(rnd, rnd.choice([5, 30, 400])), None, rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(900, None, None, "a"), (None, "one two", None, "b"), (901, "same", None, "b"), (901, "same", None, "b")]
    table = docs(spark, rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = mixing.source_targets(sizes)
    mix = mixing.mix_documents(table).collect()
    taken, times = {}, {}
    for r in mix:
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
        times[r["doc_id"], r["shard"]] = times.get((r["doc_id"], r["shard"]), 0) + 1
    assert {s: (taken[s], target[s]) for s in sizes if abs(taken[s] - target[s]) > 15} == {}
    assert all(r["size"] == 8 and r["words"] == 7 for r in mix)
    copies = {}
    for r in mix:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(n for i, n in copies.items() if i != 901) <= 3 and copies.get(901, 0) <= 6
    assert sorted(map(str, mix)) == sorted(map(str, mixing.mix_documents(table.repartition(7)).collect()))
    assert mixing.mix_documents(table.limit(0)).count() == 0


def test_mix_with_one_very_long_document(spark):
    prepared(spark)
    small = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("c").alias("source"), F.lit(100).alias("size"))
    long = spark.createDataFrame([(-1, "c", 900_000)], "doc_id long, source string, size int")
    other = spark.range(20_000, 21_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(7200).alias("size"))
    table = small.unionByName(long).unionByName(other)
    for seed in range(3):
        # c is wanted half, whatever place the order gives the long document.
        rows = mixing.plan(table, weights=(9, 1), seed=seed, blocks=4).filter("copies > 0").collect()
        target = next(r["target"] for r in rows if r["source"] == "c")
        assert target == 900_000 and abs(sum(r["size"] * r["copies"] for r in rows if r["source"] == "c") - target) <= 50
        assert all(0 <= x < mixing.SHARDS for r in rows for x in r["shard_of"])


def test_class_shares():
    assert mixing.class_shares(1000, {9: 600, 6: 300, 3: 900}) == ([9, 6], 3, 100)
    assert mixing.class_shares(10, {9: 600, 3: 90}) == ([], None, 10)


# 10


def test_top_k_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], 1) for i in range(700)]
    rows += [(700 + i, [0.5] * 8, 1) for i in range(40)]
    rows += [(800, None, 1), (801, [], 1), (802, [None] * 8, 1), (803, [float("nan")] * 8, 1), (804, [float("inf")] * 8, 1), (805, [1.0, -2.0], 1), (3, rows[3][1], 1), (None, [1.0] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = topk.top_k(table, table.filter("vec_id % 50 = 0"))
    vectors = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in vectors if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    assert set(map(tuple, found.collect())) == want
    one = table.filter("vec_id = 50")
    assert topk.top_k(one, one).count() == 0 and topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_sha_of_query_columns(spark, folder):
    """Digests of the thin queries are of the operators' own outputs."""
    from quillstack.llm.queries import QUERIES

    rows = QUERIES["op7_prefix_bpe"](spark, folder).limit(3).collect()
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_decoding_in_the_same_pass(spark, corpus):
    rows = bpe.encode(docs(spark, corpus), decoded="decoded")
    assert all(r["decoded"] == r["again"] for r in bpe.decode(rows, out="again").collect())
