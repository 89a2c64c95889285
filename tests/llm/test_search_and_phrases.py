"""SimHash components, presence-mask search and collocations against brute force, and on odd input."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quillstack.llm import collocation, lexical, simhash
from quillstack.llm.queries import prepared

DOCS = "doc_id long, text string, lang string, term string, key string, print long, part int, a long, n long, doc string"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    prepared(spark)
    return spark.createDataFrame([(i, t, lang, "x", "y", 1, 2, 3, 4, "z") for i, t, lang in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 12


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    prints = [plain_print(t) for _, t, *_ in rows]
    names = list(range(len(rows)))

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                names[root(i)] = root(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, f"{prints[i]:016x}", least.get(root(i))) for i, (doc, *_) in enumerate(rows)]


def test_simhash_against_all_pairs(spark):
    rnd = random.Random(3)
    base = [f"W{rnd.randrange(50)} " + " ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.choice([0, 1, 2, 9, 90, 500]))) for _ in range(25)]
    texts = [None, "", " \n\t", "one", "one TWO", "One two\x0bthree", "é ß É", *base, *base[:5]]
    for text in base:
        for _ in range(8):
            words = text.split()
            words[rnd.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    rows = [(i if i != 9 else None, t, "en") for i, t in enumerate(texts)] + [(40, "one", None)]
    made = simhash.near_components(docs(spark, rows))
    assert made.columns == ["doc_id", "fingerprint", "component_id"]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(plain_components(rows), key=key)


def test_simhash_long_text_and_empty_table(spark):
    text = " ".join(f"w{i % 977}" for i in range(100_000))
    assert simhash.fingerprint_of(text.encode()) == plain_print(text)
    assert simhash.near_components(docs(spark, [(1, text, "en")])).collect()[0][2] == 1
    assert simhash.near_components(docs(spark, [])).count() == 0
    assert simhash.near_components(docs(spark, [(None, None, None)])).collect()[0] == (None, "0" * 16, None)


def test_full_buckets_are_split_without_losing_links(spark):
    """A dense ball of fingerprints: buckets of over eight are split, down to bits that are all alike."""
    prepared(spark)
    rnd = random.Random(4)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(9))) & (2**64 - 1) for c in centres for _ in range(150)}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "print long"), room=8).distinct().collect()
    names = {x: x for x in signed}

    def root(names, x):
        while names[x] != x:
            x = names[x]
        return x

    assert all(((a ^ b) % 2**64).bit_count() <= 3 for a, b in found)
    for a, b in found:
        names[root(names, a)] = root(names, b)
    right = {x: x for x in signed}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) % 2**64).bit_count() <= 3:
                right[root(right, a)] = root(right, b)
    groups = lambda names: {frozenset(x for x in signed if root(names, x) == r) for r in {root(names, x) for x in signed}}
    assert groups(names) == groups(right)


def test_blocks_cover_every_three_bits():
    rnd = random.Random(5)
    masks = [m for first in simhash.split(0) for m in simhash.split(first)]
    assert len(masks) == 16 and {m.bit_count() for m in masks} == {28}
    for _ in range(500):
        differ = sum(1 << b for b in rnd.sample(range(64), 3))
        assert any(not m & differ for m in masks)


# 11


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def plain_ranks(rows, items, k):
    cut = [(d, Counter(plain_terms(t))) for d, t, *_ in rows]
    cut = [(d, c) for d, c in cut if c]
    n_docs, length = len(cut), sum(c.total() for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in cut:
            m = 100 - 75 + 75 * c.total() * n_docs // length
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t, times in Counter(plain_terms(text)).items()
            )
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("asked", [1 << 18, 40])
def test_search_against_brute_force(spark, asked, monkeypatch):
    rnd = random.Random(6)
    text = lambda n: " ".join(f"{rnd.choice(['W', 'w'])}{min(int(rnd.expovariate(0.05)), 99)}{rnd.choice(['', ',', '.', '_'])}" for _ in range(n))
    rows = [(i, text(rnd.choice([1, 5, 40, 300])), "en") for i in range(400)]
    rows += [(400 + i, rows[i][1], "en") for i in range(60)] + [(None, text(30), "en"), (900, None, "en"), (901, "", "en"), (902, "-- ..", "en"), (903, "É é W1É", "en")]
    items = [(i, text(rnd.choice([1, 8, 30, 90]))) for i in range(12)] + [(50, None), (51, "?!"), (52, "unheard"), (None, "w1 w2"), (53, "w1 w1 w1 w5 é")]
    monkeypatch.setattr(lexical, "BLOCK", 50)
    asked_rows = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc string, score long")
    made = lexical.rank_documents(docs(spark, rows), asked_rows, k=7, asked=asked)
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(plain_ranks(rows, items, 7), key=key)


def test_search_in_slices_and_on_empty_tables(spark, monkeypatch):
    text = "Aa b1-c é_d " * 500
    monkeypatch.setattr(lexical, "SLICE", 7)
    assert [t.decode() for part in lexical.terms_of(text.encode()) for t in part] == plain_terms(text)
    items = spark.createDataFrame([(1, "aa")], "item_id long, text string")
    assert lexical.rank_documents(docs(spark, []), items).count() == 0
    assert lexical.rank_documents(docs(spark, [(1, "aa", "en")]), items.limit(0)).count() == 0
    assert lexical.rank_documents(docs(spark, [(1, "aa", "en")]), items).collect()[0][:3] == (1, 1, 1)


def test_masks_of_many_terms():
    rnd = np.random.default_rng(1)
    held = rnd.random((150, 64)) < 0.01
    held[:, 10] = held[:, 20] = held[:, 30]
    codes = lexical.masks_of(np.packbits(held, axis=1, bitorder="little"))
    for i in range(64):
        for j in range(64):
            assert (codes[i] == codes[j]) == (held[:, i] == held[:, j]).all()


# 13


def plain_collocations(rows, least, k):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            counts[lang or "und"].update(tuple(words[i : i + j]) for j in range(1, 6) for i in range(len(words) - j + 1))
    out = []
    for lang, f in counts.items():
        n, scored = total[lang], []
        frequent = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        explained = {}
        for p, a in frequent.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    explained[p[i : i + size]] = max(a, explained.get(p[i : i + size], 0))
        for p, a in frequent.items():
            if 100 * explained.get(p, 0) >= 100 * a:
                continue
            score, _, l, r = min((1000 * a * n // (f[p[:c]] * f[p[c:]]), c, f[p[:c]], f[p[c:]]) for c in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def phrases(rnd, n):
    word = lambda: rnd.choice(["a", "b", "A", "c\x01", "c", "É", "of", "the", f"r{rnd.randrange(40)}", f"r{rnd.randrange(9)}"])
    fixed = ["as far as we", "new york city", "in  other\twords", "the the the the the the"]
    return " ".join(rnd.choice([word(), word(), word(), rnd.choice(fixed)]) + rnd.choice(["", "", "", "", ",", "\n", ";\r\n"]) for _ in range(n))


def test_collocations_against_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, phrases(rnd, rnd.choice([1, 20, 200])), rnd.choice(["en", "en", "fr", None, "und", "e\x00"])) for i in range(150)]
    rows += [(500, None, "en"), (501, "", None), (502, ".,;", "xx"), (503, rows[0][1], rows[0][2]), (None, phrases(rnd, 50), "en")]
    assert sorted(map(tuple, collocation.collocations(docs(spark, rows), k=10**6, least=4).collect())) == plain_collocations(rows, 4, 10**6)
    assert sorted(map(tuple, collocation.collocations(docs(spark, rows), k=9, least=20).collect())) == plain_collocations(rows, 20, 9)
    # Full memory, long pieces and bitmaps that say yes to nearly all keys change nothing.
    for name, value in (("HELD", 30), ("SLICE", 40), ("BITMAP", 64)):
        monkeypatch.setattr(collocation, name, value)
    assert sorted(map(tuple, collocation.collocations(docs(spark, rows), k=10**6, least=4).collect())) == plain_collocations(rows, 4, 10**6)


def test_collocations_of_nothing(spark):
    assert collocation.collocations(docs(spark, [])).count() == 0
    assert collocation.collocations(docs(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


def test_a_first_word_that_most_phrases_share(spark):
    """Its count reaches all partitions over which its extensions spread."""
    rows = [(i, f"the {chr(97 + i % 20)}{i % 13} {i % 3}", "en") for i in range(2600)]
    assert sorted(map(tuple, collocation.collocations(docs(spark, rows), k=10**6, least=5).collect())) == plain_collocations(rows, 5, 10**6)
