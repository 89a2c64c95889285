"""BPE encoding by per-prefix dynamic programming, and decoding, for `tokenizers` files of word-end BPE models.

A sequence of tokens is what the merges make of a text exactly if every two neighbours are: no merge of lower rank
crosses the border between them. So each prefix of a word has one last token, found among the tokens that end there
(an automaton gives them) as the one that fits the last token of the prefix before it. Back-pointers give the ids.

Null text counts as empty text: no ids, decoded "". Texts of any length take time in proportion to their length.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import map_batches, once_per_worker, parts_of

#: Pieces of text, words and pairs of tokens that a worker remembers: the first it meets, the frequent ones among them.
KEPT = 150_000
#: Bytes of text encoded at a time: ids and decoded texts of so much stand beside the batch.
PART = 1 << 20


def byte_letters() -> list[str]:
    """The letter a byte-level vocabulary writes for each byte: itself if printable, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixBpe:
    """A BPE model whose words end in a marked last byte."""

    def __init__(self, spec: dict) -> None:
        import ahocorasick

        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("expects a plain BPE model with an end-of-word suffix")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        # A token's form: one character for each byte, and other characters for bytes that end a word.
        form = {c: chr(b) for b, c in enumerate(letters)} | {c + end: chr(256 + b) for b, c in enumerate(letters)}
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {vocab[t]: -1 for t in form if t in vocab}
        if len(self.rank) != len(form):
            raise ValueError("the vocabulary lacks single bytes")
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            if t in self.rank:
                raise ValueError("two merges make one token")
            form[left + right] = form[left] + form[right]
            self.pair_rank[a, b], self.parts[t], self.rank[t] = rank, (a, b), rank
        self.token = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.matches = ahocorasick.Automaton()
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        sound: set[int] = set()
        for t, i in sorted(((t, vocab[t]) for t in form), key=lambda x: self.rank[x[1]]):
            if i not in self.parts or self._sound(i, sound):
                sound.add(i)
                self.matches.add_word(form[t], (i, len(form[t])))
        self.size = {vocab[t]: len(f) for t, f in form.items()}
        self.matches.make_automaton()

    def _edge(self, token: int, side: int, until: float) -> list[tuple[int, float]]:
        """The tokens that stand at one end of ``token`` while it is made, each with the rank that uses it up."""
        out = [(token, until)]
        while token in self.parts:
            until, token = self.rank[token], self.parts[token][side]
            out.append((token, until))
        return out

    def _crossed(self, a: int, b: int, until: float, but: int = -1) -> bool:
        ranks = self.pair_rank
        for x, x_end in self._edge(a, 1, until):
            for y, y_end in self._edge(b, 0, until):
                rank = ranks.get((x, y))
                # Of equal ranks the leftmost merges first.
                if rank is not None and rank != but and rank < x_end and rank <= y_end:
                    return True
        return False

    def _sound(self, token: int, sound: set[int]) -> bool:
        """Whether the merges make ``token`` of its own text."""
        a, b = self.parts[token]
        return a in sound and b in sound and not self._crossed(a, b, self.rank[token], self.rank[token])

    def word(self, word: str) -> bytes:
        """Ids of one word (one match of the splitting pattern), as bytes of 32-bit integers."""
        ids = self.words.get(word)
        if ids is None:
            raw = word.encode("utf-8", "surrogatepass")
            ids = self._last_tokens(raw[:-1].decode("latin-1") + chr(256 + raw[-1]))
            if len(self.words) < KEPT:
                self.words[word] = ids
        return ids

    def _last_tokens(self, form: str) -> bytes:
        """The last token of every prefix, from left to right; then back from the whole word."""
        last, known, done = [-1] * (len(form) + 1), self.fits.get, 0
        for end, (token, size) in self.matches.iter(form):
            if end < done:  # this prefix has its token
                continue
            before = end + 1 - size
            if before:
                good = known(last[before] << 20 | token)
                if good is None:
                    good = self._fit(last[before], token)
                if not good:
                    continue
            done = end + 1
            last[done] = token
        ids, at, size = [], len(form), self.size
        while at:
            ids.append(last[at])
            at -= size[last[at]]
        return array("i", ids[::-1]).tobytes()

    def _fit(self, a: int, b: int) -> bool:
        good = not self._crossed(a, b, math.inf)
        if len(self.fits) < KEPT:
            self.fits[a << 20 | b] = good
        return good


class Encoder(dict):
    """The whole tokenizer: added tokens, normaliser (NFC, blanks, lower case), splitting pattern, model.

    No step looks across a space, so the ids of the pieces between spaces are remembered, as bytes of 32-bit integers.
    """

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel":
            raise ValueError("this tokenizer file has other steps than NFC, blanks, lower case, pattern and bytes")
        if spec["decoder"] is not None or spec["post_processor"] is not None or any(" " in x["content"] for x in spec["added_tokens"]):
            raise ValueError("this tokenizer file has a decoder, a post-processor or added tokens with spaces")
        self.model = PrefixBpe(spec)
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.added = re.compile("|".join(map(re.escape, sorted(self.model.added, key=len, reverse=True))) or r"(?!)")

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            # Lower case letter by letter: a final capital sigma has no form of its own.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def __missing__(self, piece: str) -> bytes:
        if self.added.search(piece):
            out, at = [], 0
            for m in self.added.finditer(piece):
                out += [*map(self.model.word, self._words(piece[at : m.start()])), array("i", [self.model.added[m.group()]]).tobytes()]
                at = m.end()
            return b"".join([*out, *map(self.model.word, self._words(piece[at:]))])
        ids = b"".join(map(self.model.word, self._words(piece)))
        if len(self) < KEPT and len(piece) < 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as bytes of 32-bit integers."""
        return b"".join([self[p] for p in text.replace("\n", " ").split(" ")])


def read_tokenizer(path: str) -> str:
    """The tokenizer file's text; small, and sent to tasks once."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokens(spec: str) -> np.ndarray:
    """The text of every id."""
    parsed = json.loads(spec)
    pairs = [(i, t) for t, i in parsed["model"]["vocab"].items()] + [(x["id"], x["content"]) for x in parsed["added_tokens"]]
    named = np.full(max(i for i, _ in pairs) + 1, "", object)
    for i, t in pairs:
        named[i] = t
    return named


def _texts(tokens: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    words = tokens[ids].tolist()
    return pa.array([" ".join(words[e - n : e]) for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist())], pa.string())


def encode(docs: DataFrame, text: str = "text", path: str | None = None, out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with an array<int> column of token ids of the whole text; null text has none.

    With ``decoded``, a column of that name holds what the ids decode to, made in the same pass. Columns of these names
    are replaced.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path or default_path()))
    new = [out, decoded] if decoded else [out]
    kept = docs.drop(*new)
    schema = kept.select("*", F.expr("cast(array() as array<int>)").alias(out), *[F.lit("").alias(c) for c in new[1:]]).schema
    where = kept.columns.index(text)

    def make():
        name = zlib.crc32(spec.value.encode())
        encoder = once_per_worker(f"bpe {name}", lambda: Encoder(spec.value))
        tokens = once_per_worker(f"tokens {name}", lambda: _tokens(spec.value)) if decoded else None

        def one(whole):
            for batch in parts_of(whole, where, PART):
                ids = [encoder.encode(t or "") for t in batch.column(where).to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), np.int32)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                columns = [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(flat))]
                if decoded:
                    columns.append(_texts(tokens, flat, sizes))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *new])

        return one

    return map_batches(kept, make, schema, keeps=True)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids``: the tokens joined by blanks, special tokens kept; null ids give ""."""
    spec = rows.sparkSession.sparkContext.broadcast(read_tokenizer(path or default_path()))
    kept = rows.drop(out)
    schema = kept.select("*", F.lit("").cast("string").alias(out)).schema
    where = kept.columns.index(ids)

    def make():
        tokens = once_per_worker(f"tokens {zlib.crc32(spec.value.encode())}", lambda: _tokens(spec.value))

        def one(batch):
            column = batch.column(where)
            sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, _texts(tokens, flat, sizes)], [*batch.schema.names, out])

        return one

    return map_batches(kept, make, schema, keeps=True)
