"""Paragraphs, chunks and parse elements.

A document is one row and every splitter works inside it, on array expressions, so chunking needs no shuffle and
scales with the number of rows; only the final ``posexplode`` multiplies them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.arrays import explode_items, let
from quillstack.functions.text import (
    CLOSE_MARK, OPEN_MARK, escape_marks, estimate_tokens, has_content, regex_literal, strip, unescape_marks,
)

# Separators, coarsest first.
DEFAULT_SEPARATORS = ["\n\n", "\n", "。", "！", "？", ". ", ", ", " "]

# Regions that are never split.
PROTECTED_PATTERNS = [
    r"```[\s\S]*?```",
    r"\$\$[\s\S]*?\$\$",
    r"\$[^$\n]+\$",
    r"!\[.*?\]\(.*?\)",
    r"\[.*?\]\(.*?\)",
    r"(?:^|\n)[ \t]*\|[^\n]*\|[ \t]*[\r\n]+",
]

LINE_BREAKS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
ATX_HEADER = r"[ \t]{0,3}#{1,6}[ \t]"


@dataclass(frozen=True)
class ChunkConfig:
    """Chunking parameters. ``size`` None means: no window, the units themselves are the chunks."""

    size: int | None = 1000
    overlap: int = 200
    separators: tuple[str, ...] = field(default_factory=lambda: tuple(DEFAULT_SEPARATORS))
    protect: bool = True
    use_token_count: bool = False

    def __post_init__(self):
        if self.size is not None and self.size <= 0:
            raise ValueError("size must be positive")
        if self.overlap < 0 or (self.size is not None and self.overlap >= self.size):
            raise ValueError("overlap must be at least 0 and smaller than size")
        if self.use_token_count and self.size is None:
            raise ValueError("token counting needs a size")


def non_blank(items: Column) -> Column:
    return F.filter(items, has_content)


def paragraphs(text: Column) -> Column:
    """Paragraphs of plain text."""
    return non_blank(F.split(text, "\n\n"))


def parse_paragraphs(df: DataFrame, content: str = "parsed_content") -> DataFrame:
    """Parse results (JSON with segments, tables and figures) as ordered paragraph rows."""
    item = "array<struct<text:string,metadata:map<string,string>>>"
    parsed = F.from_json(F.col(content), f"segments {item}, tables {item}, figures {item}")
    rows = df.withColumn("__parsed", parsed)
    empty = F.array().cast(item)

    def tagged(kind: str, name: str) -> Column:
        items = F.coalesce(F.col(f"__parsed.{name}"), empty)
        return F.transform(
            items, lambda x: F.struct(F.lit(kind).alias("kind"), x["text"].alias("text"), x["metadata"].alias("metadata"))
        )

    parts = [tagged("segment", "segments"), tagged("table", "tables"), tagged("figure", "figures")]
    kept = [c for c in df.columns if c != content]
    return explode_items(rows, F.concat(*parts), "__item", "position", kept).select(*kept, "position", "__item.*")


def char_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each starting ``max(size - overlap, 1)`` after the last; ends with the text.

    One regular expression steps through the text and captures each window by look-ahead, which stays linear for long
    texts (``substring`` would walk from the start for each window).
    """
    step = max(size - overlap, 1)
    pattern = F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}")

    def windows(t: Column) -> Column:
        count = F.ceil(F.greatest(F.length(t) - size, F.lit(0)) / F.lit(step)).cast("int") + 1
        return F.slice(F.regexp_extract_all(t, pattern, F.lit(1)), F.lit(1), count)

    return let(text, windows)


def kept_chunks(windows: Column) -> Column:
    """Non-blank windows without the white space at their ends."""
    return F.transform(non_blank(windows), strip)


def fixed_size_chunks(text: Column, size: int | None, overlap: int = 0) -> Column:
    return kept_chunks(F.array(text) if size is None else char_windows(text, size, overlap))


def separator_pattern(separators: list[str] | tuple[str, ...]) -> str:
    return "(" + "|".join(regex_literal(s) for s in (separators or DEFAULT_SEPARATORS)) + ")"


def unit_pattern(separators: list[str] | tuple[str, ...]) -> str:
    """Text up to and with the next separator, or to the end.

    Runs without the first character of any separator are passed over at once and never given back, so matching is
    linear and needs no stack. Empty separators split nothing.
    """
    used = [s for s in (separators or DEFAULT_SEPARATORS) if s]
    if not used:
        return r"(?s).++"
    any_of = "|".join(regex_literal(s) for s in used)
    starts = "".join(dict.fromkeys(f"\\x{{{ord(s[0]):x}}}" for s in used))
    return f"(?s)[^{starts}]*+(?:(?!{any_of})[{starts}][^{starts}]*+)*+(?:{any_of}|\\z)"


def split_units(text: Column, separators: list[str] | tuple[str, ...] = ()) -> Column:
    """Units between separators; a separator stays at the end of the unit before it. Blank units are dropped."""
    return non_blank(F.regexp_extract_all(text, F.lit(unit_pattern(separators)), F.lit(0)))


def protected_segments(text: Column, patterns: list[str] | None = None) -> Column:
    """Alternating free and protected segments; overlapping or touching protected ranges are one segment.

    Each pattern puts marks around its matches. Later patterns see the text with the earlier marks, so ranges may nest
    or cross, and a position is protected while more ranges are open than closed. Control characters of the text that
    look like marks are escaped before and put back after.
    """
    marked = escape_marks(text)
    for pattern in PROTECTED_PATTERNS if patterns is None else patterns:
        marked = F.regexp_replace(marked, f"(?sm)({pattern})", f"{OPEN_MARK}$1{CLOSE_MARK}")
    start = F.struct(
        F.lit(0).alias("depth"), F.array().cast("array<struct<protected:boolean,text:string>>").alias("segments")
    )

    def take(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece.startswith(OPEN_MARK), 1).when(piece.startswith(CLOSE_MARK), -1).otherwise(0)
        body = F.regexp_replace(piece, f"[{OPEN_MARK}{CLOSE_MARK}]", "")
        done = state["segments"]
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(F.lit(True).alias("protected"), F.concat(last["text"], body).alias("text"))),
        )
        pushed = F.concat(done, F.array(F.struct((depth > 0).alias("protected"), body.alias("text"))))
        segments = F.when(body == "", done).when((depth > 0) & last["protected"], joined).otherwise(pushed)
        return F.struct(depth.alias("depth"), segments.alias("segments"))

    def plain(segments: Column) -> Column:
        return F.transform(segments, lambda s: F.struct(s["protected"].alias("protected"), unescape_marks(s["text"]).alias("text")))

    def segments_of(m: Column) -> Column:
        pieces = F.split(m, f"(?=[{OPEN_MARK}{CLOSE_MARK}])")
        single = F.array(F.struct(F.lit(False).alias("protected"), unescape_marks(m).alias("text")))
        return F.when(F.contains(m, F.lit(OPEN_MARK)), plain(F.aggregate(pieces, start, take)["segments"])).otherwise(single)

    return let(marked, segments_of)


def split_units_protected(
    text: Column, separators: list[str] | tuple[str, ...] = (), patterns: list[str] | None = None
) -> Column:
    """Like ``split_units``, but protected regions (code, formulas, images, links, table rows) are single units."""
    return F.flatten(
        F.transform(
            protected_segments(text, patterns),
            lambda s: F.when(s["protected"], non_blank(F.array(s["text"]))).otherwise(split_units(s["text"], separators)),
        )
    )


def units_of(text: Column, config: ChunkConfig) -> Column:
    return (split_units_protected if config.protect else split_units)(text, config.separators)


def explode_chunks(df: DataFrame, chunks: Column, text: str = "text") -> DataFrame:
    """One row per chunk of an array column, with its index; the source text column is dropped."""
    kept = [c for c in df.columns if c != text]
    return explode_items(df, chunks, "chunk", "index", kept)


def recursive_chunks(df: DataFrame, config: ChunkConfig, paragraphs_col: str = "paragraphs") -> DataFrame:
    """Split paragraphs into units, join what is kept and window it.

    ``paragraphs_col`` is ``array<struct<text, metadata>>``. Each chunk carries the metadata of the paragraph its
    first character comes from.
    """
    kept = [c for c in df.columns if c != paragraphs_col]
    items = F.filter(F.col(paragraphs_col), lambda p: has_content(p["text"]))
    units = F.flatten(
        F.transform(
            items,
            lambda p: F.transform(
                units_of(p["text"], config), lambda u: F.struct(u.alias("text"), p["metadata"].alias("metadata"))
            ),
        )
    )
    if config.size is None:
        chunks = F.transform(units, lambda u: F.struct(strip(u["text"]).alias("text"), u["metadata"].alias("metadata")))
        return explode_items(df, chunks, "__c", "index", kept).select(*kept, "index", "__c.*")
    if config.use_token_count:
        rows = df.withColumn("__units", units)
        texts = F.transform("__units", lambda u: u["text"])
        rows = rows.withColumn("__merged", merge_by_tokens(texts, config.size, config.overlap))
        chunks = F.transform(
            "__merged",
            lambda m: F.struct(m["text"].alias("text"), F.col("__units")[m["first"]]["metadata"].alias("metadata")),
        )
        return explode_items(rows, chunks, "__c", "index", kept).select(*kept, "index", "__c.*")

    # One entry per paragraph: its kept text and metadata, then the offset at which each starts.
    merged = F.filter(
        F.transform(
            items,
            lambda p: F.struct(
                F.array_join(units_of(p["text"], config), "").alias("text"), p["metadata"].alias("metadata")
            ),
        ),
        lambda p: F.length(p["text"]) > 0,
    )
    rows = df.withColumn("__kept", merged)
    offsets = F.aggregate(
        F.col("__kept"),
        F.array(F.lit(0)),
        lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p["text"]))),
    )
    rows = rows.withColumn("__offsets", offsets).withColumn(
        "__text", F.array_join(F.transform("__kept", lambda p: p["text"]), "")
    )
    step = max(config.size - config.overlap, 1)
    windows = F.transform(
        char_windows(F.col("__text"), config.size, config.overlap),
        lambda w, i: F.struct(w.alias("text"), (i * step).alias("start")),
    )
    chunks = F.transform(
        F.filter(windows, lambda w: has_content(w["text"])),
        lambda w: F.struct(
            strip(w["text"]).alias("text"),
            F.col("__kept")[
                F.least(F.size(F.filter("__offsets", lambda o: o <= w["start"])), F.size("__kept")) - 1
            ]["metadata"].alias("metadata"),
        ),
    )
    return explode_items(rows, chunks, "__c", "index", kept).select(*kept, "index", "__c.*")


def markdown_sections(text: Column, headers: list[str] | None = None) -> Column:
    """``array<struct<header, text>>`` cut before each header line.

    Default headers are ``#`` to ``######``. ``headers`` gives line prefixes instead, the longest tried first.
    """
    if headers:
        prefixes = "|".join(regex_literal(h) for h in sorted(headers, key=len, reverse=True))
        pattern = f"[ \\t]*(?:{prefixes})"
    else:
        pattern = ATX_HEADER
    lines = F.regexp_replace(F.regexp_replace(text, LINE_BREAKS, "\n"), r"\n\z", "")
    parts = F.filter(F.split(lines, f"(?m)(?=^(?:{pattern}))"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(p.rlike(rf"\A{pattern}"), strip(F.regexp_extract(p, r"\A[^\n]*", 0))).otherwise(F.lit("")).alias("header"),
            F.regexp_replace(p, r"\n\z", "").alias("text"),
        ),
    )


def markdown_chunks(
    df: DataFrame, config: ChunkConfig, text: str = "text", headers: list[str] | None = None
) -> DataFrame:
    """Chunks per markdown section with the section's header; texts without any header are chunked recursively."""
    kept = [c for c in df.columns if c != text]
    rows = df.withColumn("__sections", markdown_sections(F.col(text), headers))
    sections = F.col("__sections")

    def windows_of(section: Column) -> Column:
        if config.separators == tuple(DEFAULT_SEPARATORS):
            return F.array(section) if config.size is None else char_windows(section, config.size, config.overlap)
        def cut(units: Column) -> Column:
            units = F.when(F.size(units) > 0, units).otherwise(F.array(section))
            if config.size is None:
                return units
            total = F.array_join(units, "")
            return F.when(F.length(total) <= config.size, units).otherwise(char_windows(total, config.size, config.overlap))

        return let(split_units(section, config.separators), cut)

    plain = kept_chunks(
        units_of(F.col(text), config) if config.size is None
        else char_windows(F.array_join(units_of(F.col(text), config), ""), config.size, config.overlap)
    )
    headed = F.flatten(
        F.transform(
            sections,
            lambda s: F.transform(
                kept_chunks(windows_of(s["text"])), lambda w: F.struct(s["header"].alias("section"), w.alias("text"))
            ),
        )
    )
    unheaded = F.transform(plain, lambda w: F.struct(F.lit("").alias("section"), w.alias("text")))
    chunks = F.when((F.size(sections) == 1) & (sections[0]["header"] == ""), unheaded).otherwise(headed)
    return explode_items(rows, chunks, "__c", "index", kept).select(*kept, "index", "__c.*")


def token_windows(text: Column, max_tokens: int, overlap_tokens: int = 0) -> Column:
    """Split over-long text at four characters per token."""
    if max_tokens <= 0 or not 0 <= overlap_tokens < max_tokens:
        raise ValueError("need max_tokens > overlap_tokens >= 0")
    return char_windows(text, 4 * max_tokens, 4 * overlap_tokens)


def merge_by_tokens(units: Column, size: int, overlap: int, counter: Callable[[str], int] | None = None) -> Column:
    """Merge an array of units greedily up to ``size`` tokens; ``array<struct<text, first>>`` of non-blank chunks.

    The last units that fit into ``overlap`` tokens (and leave room for the next unit) open the next chunk.
    ``first`` is the position of the unit a chunk starts with. Longer units are split first. ``counter`` counts the
    tokens of a string; the default is a quarter of its length.

    With the running token counts of the pieces, the piece that ends a chunk and the one that the next chunk begins with
    follow from comparisons, so one pass over the pieces notes the borders; only a caller's counter runs in Python.
    """
    overlap = min(max(overlap, 0), size - 1)

    def pieces_of(text: Column, position: Column) -> Column:
        def with_tokens(texts: Column) -> Column:
            return F.transform(texts, lambda t: F.struct(t.alias("text"), F.floor(F.length(t) / 4).cast("long").alias("tokens"), position.alias("first")))

        short = F.floor(F.length(text) / 4) <= size
        return with_tokens(F.when(short, F.array(text)).otherwise(non_blank(char_windows(text, 4 * size, 4 * overlap))))

    @F.pandas_udf("array<struct<text:string,tokens:bigint,first:int>>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        width, step = 4 * size, 4 * (size - overlap)

        def cut(unit: str) -> list[str]:
            if counter(unit) <= size:
                return [unit]
            starts = range(0, max(len(unit) - width, 0) + step, step)
            return [piece for piece in (unit[s : s + width] for s in starts) if piece.strip()]

        for batch in batches:
            yield pd.Series([None if items is None else [{"text": t, "tokens": counter(t), "first": i} for i, u in enumerate(items) for t in cut(u)] for items in batch])

    def chunks_of(pieces: Column) -> Column:
        return let(running(F.transform(pieces, lambda p: p["tokens"])), lambda total: cut_at(pieces, total))

    def running(counts: Column) -> Column:
        """Tokens before each piece, and of all."""
        empty = F.array(F.lit(0).cast("long"))
        return F.aggregate(counts, empty, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def cut_at(pieces: Column, total: Column) -> Column:
        state = F.struct(F.lit(0).alias("begin"), F.array().cast("array<struct<begin:int,end:int>>").alias("chunks"))
        none = F.sequence(F.lit(1), F.size(pieces) - 1)
        places = F.when(F.size(pieces) > 1, none).otherwise(F.array().cast("array<int>"))

        def step(acc: Column, i: Column) -> Column:
            begin, after = acc["begin"], total[i + 1]
            # The first piece from which what is held fits into the overlap and leaves room for piece i.
            bound = F.greatest(total[i] - overlap, after - size)
            held = F.slice(total, begin + 1, i - begin + 1)
            later = begin + F.size(F.filter(held, lambda t: t < bound))
            ended = F.concat(acc["chunks"], F.array(F.struct(begin.alias("begin"), i.alias("end"))))
            full = after - total[begin] > size
            return F.struct(
                F.when(full, F.least(later, i)).otherwise(begin).alias("begin"), F.when(full, ended).otherwise(acc["chunks"]).alias("chunks")
            )

        def texts(done: Column) -> Column:
            last = F.array(F.struct(done["begin"].alias("begin"), F.size(pieces).alias("end")))
            joined = F.transform(
                F.concat(done["chunks"], last),
                lambda c: F.struct(
                    strip(F.array_join(F.transform(F.slice(pieces, c["begin"] + 1, c["end"] - c["begin"]), lambda p: p["text"]), "")).alias("text"),
                    pieces[c["begin"]]["first"].alias("first"),
                ),
            )
            return F.filter(joined, lambda c: has_content(c["text"]))

        found = let(F.aggregate(places, state, step), texts)
        return F.when(F.size(pieces) > 0, found).otherwise(F.array().cast("array<struct<text:string,first:int>>"))

    return let(counted(units) if counter else F.flatten(F.transform(units, pieces_of)), chunks_of)


def attach_media_context(chunks: Column, table_size: int = 0, image_size: int = 0) -> Column:
    """Give table and image chunks the end of the chunk before and the start of the chunk after (original texts)."""
    if table_size <= 0 and image_size <= 0:
        return chunks

    def widened(text: Column, i: Column, chunks: Column) -> Column:
        size = F.lit(0)
        if image_size > 0:
            size = F.when(is_image_chunk(text), image_size).otherwise(size)
        if table_size > 0:
            size = F.when(is_table_chunk(text), table_size).otherwise(size)
        before = F.when(i > 0, F.get(chunks, i - 1))
        after = F.get(chunks, i + 1)
        prefix = F.when(F.length(before) > 0, F.concat(strip(F.right(before, size)), F.lit("\n\n")))
        suffix = F.when(F.length(after) > 0, F.concat(F.lit("\n\n"), strip(F.left(after, size))))
        return F.when(size > 0, F.concat(F.coalesce(prefix, F.lit("")), text, F.coalesce(suffix, F.lit("")))).otherwise(text)

    return let(chunks, lambda bound: F.transform(bound, lambda text, i: widened(text, i, bound)))


def is_table_chunk(text: Column) -> Column:
    """A ``|cell|`` row after a line break, or two piped lines with a separator row among them."""
    piped_lines = F.size(F.filter(F.split(text, "\n"), lambda line: F.contains(line, F.lit("|"))))
    return text.rlike(r"\n\s*\|[^|\n]+\|") | (
        (piped_lines >= 2) & (F.regexp_count(text, F.lit(r"\|")) >= 4) & text.rlike(r"\|[-:]+[-|:]*\|")
    )


def is_image_chunk(text: Column) -> Column:
    return text.rlike(r"(?s)!\[.*?\]\(.*?\)")


def chunk_stats(chunks: DataFrame, keys: list[str], text: str = "chunk") -> DataFrame:
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunks"), F.avg(F.length(text)).alias("mean_length")
    )


def with_token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("tokens", estimate_tokens(F.col(text)))


def latest_parse(parses: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest parse per document; rows without a time come last."""
    row = F.struct(*parses.columns)
    return parses.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def filter_elements(
    elements: DataFrame, kinds: list[str] | None = None, pages: list[int] | None = None, has_image: bool | None = None
) -> DataFrame:
    """Elements of the given kinds and pages, with or without an image."""
    out = elements
    if kinds is not None:
        out = out.filter(F.col("kind").isin(kinds))
    if pages is not None:
        out = out.filter(F.col("page_number").isin(pages))
    if has_image is not None:
        out = out.filter(F.col("has_image") == has_image)
    return out


def element_summary(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: elements, elements with an image, distinct pages and kinds. One pass, partial counts per kind and page."""
    per_kind_page = elements.groupBy(*keys, "kind", "page_number").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if("has_image").alias("__img")
    )
    return per_kind_page.groupBy(*keys).agg(
        F.sum("__n").alias("elements"),
        F.sum("__img").alias("with_image"),
        F.countDistinct("page_number").alias("pages"),
        F.countDistinct("kind").alias("kinds"),
    )


def element_counts(elements: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Counts per document and kind or page, as rows (a map per document could grow without bound)."""
    return elements.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("elements"))
