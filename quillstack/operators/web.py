"""Links, URL rules, page cleaning and HTML to markdown, all as JVM-side expressions on one page per row."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.arrays import explode_items, let
from quillstack.functions.text import CLOSE_MARK, OPEN_MARK, escape_marks, has_content, strip, unescape_marks
from quillstack.functions.windows import salted_join

# Elements whose content is never text.
UNWANTED_TAGS = ["script", "style", "noscript", "iframe", "svg"]

#: Named character references of HTML 4 and the apostrophe, from the standard library; a no-break space becomes a blank.
REFERENCES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "}

COMMENT = r"(?s)<!--.*?-->"


def tag_pattern(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"


# Markdown written for each tag, applied in order. Replacements use $1 for groups.
MARKDOWN_RULES = [
    (r"[ \t\r\n\f]+", " "),
    *[(rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)],
    (r"(?i)</h[1-6]\s*>", "\n\n"),
    (r"(?i)<br\b[^>]*>", "  \n"),
    (r"(?i)<hr\b[^>]*>", "\n\n* * *\n\n"),
    (r"(?i)<li\b[^>]*>", "\n  * "),
    (r"(?i)<blockquote\b[^>]*>", "\n\n> "),
    (r"(?i)</?(p|div|ul|ol|article|section|header|footer|nav|main|blockquote|pre|body)\b[^>]*>", "\n\n"),
    (r"(?i)</?(b|strong)\b[^>]*>", "**"),
    (r"(?i)</?(i|em)\b[^>]*>", "_"),
    (r"(?i)</?code\b[^>]*>", "`"),
    (r'(?i)<img\b[^>]*\bsrc="([^"]*)"[^>]*\balt="([^"]*)"[^>]*>', "![$2]($1)"),
    (r'(?i)<img\b[^>]*\balt="([^"]*)"[^>]*\bsrc="([^"]*)"[^>]*>', "![$1]($2)"),
    (r'(?i)<img\b[^>]*\bsrc="([^"]*)"[^>]*>', "![]($1)"),
    (r'(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a\s*>', "[$2]($1)"),
    (r"<[^>]*>", ""),
]

# Blank lines and blanks left over by the rules.
TIDY_RULES = [(r"[ \t]+\n", "\n"), (r"\n[ \t]+([^ \t*])", "\n$1"), (r"\n{3,}", "\n\n")]


def unescape(text: Column) -> Column:
    """Character references, named and numeric, replaced in one pass; unknown ones stay as they are."""
    table = F.expr("map(" + ", ".join(rf"'{name}', '\u{ord(sign):04x}'" for name, sign in REFERENCES.items()) + ")")

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7))
        code = digits.cast("int")
        fits = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        # The few common names are looked at first: a literal map is searched from its start.
        common = F.when(name == "amp", "&").when(name == "lt", "<").when(name == "gt", ">").when(name == "quot", '"').when(name == "nbsp", " ")
        named = common.when(~name.startswith("#") & (name != ""), F.element_at(table, name))
        sign = F.coalesce(named, F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        return F.coalesce(F.concat(sign, F.substr(piece, F.length(name) + 2)), F.concat(F.lit("&"), piece))

    def joined(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decoded)
        return F.array_join(F.concat(F.slice(parts, 1, 1), rest), "")

    return F.when(text.contains("&"), let(F.split(text, "&"), joined)).otherwise(text)


#: Elements without content or a closing tag.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
TAG_NAME = r"\A</?([A-Za-z][A-Za-z0-9-]*)"


def _tag_pieces(html: Column) -> Column:
    """The page cut before each tag: every piece but the first begins with one."""
    return F.split(html, r"(?=</?[A-Za-z])")


def _popped(stack: Column, name: Column) -> Column:
    """Open elements left once ``name`` is closed: those above its last opening end with it; -1 if it is not open."""
    place = F.array_position(F.reverse(stack), name).cast("int")
    return F.when(place > 0, F.size(stack) - place).otherwise(F.lit(-1))


def remove_elements(html: Column, selected: str) -> Column:
    """Drop the elements whose opening tag matches ``selected``, with all they hold.

    One pass over the tags keeps the names of the open elements. An element ends at its own closing tag, however many of
    its name it holds, or where an element around it ends.
    """
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, TAG_NAME, 1))
        opened, skip, kept = state["open"], state["skip"], state["kept"]
        closing, plain = piece.startswith("</"), name == ""
        single = name.isin(VOID_TAGS) | piece.rlike(r"\A<[^>]*/>")
        hit = piece.rlike(rf"(?is)\A<(?!/){selected}")
        after = F.regexp_replace(piece, r"\A<[^>]*>?", "")
        left = _popped(opened, name)
        # Closed: the element itself, or one around it; its own closing tag goes with it.
        ends = closing & (skip > 0) & (left >= 0) & (left < skip)
        own = ends & (left == skip - 1)
        stack = F.when(plain | (~closing & single), opened).when(~closing, F.concat(opened, F.array(name))).when(left >= 0, F.slice(opened, F.lit(1), F.greatest(left, F.lit(0)))).otherwise(opened)
        begins = ~closing & ~plain & ~single & hit & (skip == 0)
        now = F.when(begins, F.size(opened) + 1).when(ends, F.lit(0)).otherwise(skip)
        shown = F.when((skip == 0) & single & hit & ~closing, after).when((skip == 0) & ~begins, piece).when(own, after).when(ends, piece)
        return F.struct(stack.alias("open"), now.alias("skip"), F.when(shown.isNull(), kept).otherwise(F.concat(kept, F.array(shown))).alias("kept"))

    cleaned = F.array_join(F.aggregate(_tag_pieces(html), start, step)["kept"], "")
    return F.when(html.rlike(rf"(?is)<{selected}"), cleaned).otherwise(html)


def remove_unwanted(html: Column, selectors: list[str] | None = None) -> Column:
    """Drop scripts, styles and the like, and elements named by ``tag``, ``.class`` or ``#id`` selectors, nested ones too."""
    html = F.regexp_replace(html, COMMENT, "")
    for tag in UNWANTED_TAGS:
        html = F.regexp_replace(html, tag_pattern(tag), "")
    for selector in selectors or []:
        if selector.startswith("."):
            name = selector[1:]
            wanted = rf"""[a-z0-9-]+\b[^>]*?\sclass\s*=\s*(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?'|{name}(?=[\s>]))"""
        elif selector.startswith("#"):
            name = selector[1:]
            wanted = rf"""[a-z0-9-]+\b[^>]*?\sid\s*=\s*(?:"{name}"|'{name}'|{name}(?=[\s>]))"""
        elif selector.replace("-", "").isalnum():
            wanted = rf"{selector}(?![a-z0-9-])"
        else:
            raise ValueError(f"selector {selector} is not a tag, .class or #id")
        html = _let_removed(html, wanted)
    return html


def _let_removed(html: Column, wanted: str) -> Column:
    return let(html, lambda page: remove_elements(page, wanted))


def page_title(html: Column) -> Column:
    """Text of the title, else of the first heading, else the og:title; null when there is none."""

    def text_of(pattern: str) -> Column:
        return F.nullif(strip(unescape(F.regexp_extract(html, pattern, 1))), F.lit(""))

    return F.coalesce(
        text_of(r"(?is)<title\b[^>]*>([^<]*)</title"),
        F.nullif(strip(unescape(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1", 1), r"<[^>]*>", ""))), F.lit("")),
        text_of(r'(?is)<meta\b[^>]*property\s*=\s*"og:title"[^>]*content\s*=\s*"([^"]*)"'),
        text_of(r'(?is)<meta\b[^>]*content\s*=\s*"([^"]*)"[^>]*property\s*=\s*"og:title"'),
    )


def _apply(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def table_markdown(html: Column) -> Column:
    """An HTML table as markdown rows; the first row is the header, written once."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr|</table|\z)"), F.lit(1))

    def cells(row: Column) -> Column:
        inner = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]|\z)"), F.lit(1))
        plain = lambda cell: strip(
            F.regexp_replace(F.replace(unescape(F.regexp_replace(cell, r"<[^>]*>", "")), F.lit("|"), F.lit("\\|")), r"\s+", " ")
        )
        return F.transform(inner, plain)

    def assembled(lines: Column) -> Column:
        columns = F.regexp_count(lines[0], F.lit(r"(?<!\\)\|")) - 1
        header = F.concat(lines[0], F.lit("\n|"), F.repeat(F.lit(" --- |"), columns))
        body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
        return F.when(F.size(lines) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.array(header), body), "\n"))

    return let(F.transform(F.filter(F.transform(rows, cells), lambda c: F.size(c) > 0), _table_line), assembled)


def _table_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


#: Pages that need more than the rules: ordered or nested lists and preformatted text.
STRUCTURED = r"(?i)<(?:ol|pre)\b|<ul\b[^<]*+(?:<(?!/?[uo]l\b)[^<]*+)*+<[uo]l\b"
#: Single-quoted and bare values of the attributes that the rules read.
BARE_ATTRIBUTE = r"""(?i)<[a-z][^>]*?\s(?:href|src|alt)\s*=\s*(?:'|[^\s"'>]|\s+")"""


def _quoted_attributes(html: Column) -> Column:
    """Values of href, src and alt in double quotes."""
    out = html
    for _ in range(2):  # an image has two of them
        out = F.regexp_replace(out, r"""(?i)(<[a-z][^>]*?\s)(href|src|alt)\s*=\s*'([^'">]*)'""", '$1$2="$3"')
        out = F.regexp_replace(out, r"""(?i)(<[a-z][^>]*?\s)(href|src|alt)\s*=\s*([^\s"'>]+)""", '$1$2="$3"')
    return F.when(html.rlike(BARE_ATTRIBUTE), out).otherwise(html)


def _structured(html: Column) -> Column:
    """Lists with their depth and numbers, and preformatted lines, written so that the rules leave them as they are.

    Marks stand for line breaks and blanks until the rules are done.
    """
    none = F.array()
    start = F.struct(
        none.cast("array<string>").alias("lists"), none.cast("array<int>").alias("counts"), F.lit(0).alias("pre"), none.cast("array<string>").alias("out")
    )

    def fixed(text: Column) -> Column:
        lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "\t", "    ")
        return F.replace(F.replace(lines, F.lit("\n"), F.lit(OPEN_MARK + "    ")), F.lit(" "), F.lit(CLOSE_MARK))

    def step(state: Column, piece: Column) -> Column:
        name, closing = F.lower(F.regexp_extract(piece, TAG_NAME, 1)), piece.startswith("</")
        lists, counts, pre = state["lists"], state["counts"], state["pre"]
        rest, depth = F.regexp_replace(piece, r"\A<[^>]*>", ""), F.size(state["lists"])
        is_list, is_item = name.isin("ul", "ol"), (name == "li") & ~closing & (F.size(state["lists"]) > 0)
        count = F.when(depth > 0, F.element_at(counts, -1)).otherwise(0) + 1
        sign = F.when(F.element_at(lists, -1) == "ol", F.concat(count.cast("string"), F.lit(". "))).otherwise(F.lit("* "))
        item = F.concat(F.lit(OPEN_MARK), F.repeat(F.lit(CLOSE_MARK * 2), depth), sign, F.ltrim(rest))
        border = F.when((depth == 0) | (closing & (depth == 1)), F.lit("<p>")).otherwise(F.lit(""))
        shorter = F.greatest(depth - 1, F.lit(0))
        last = F.greatest(F.size(counts) - 1, F.lit(0))
        return F.struct(
            F.when(is_list & ~closing, F.concat(lists, F.array(name))).when(is_list, F.slice(lists, F.lit(1), shorter)).otherwise(lists).alias("lists"),
            F.when(is_list & ~closing, F.concat(counts, F.array(F.lit(0)))).when(is_list, F.slice(counts, F.lit(1), last))
            .when(is_item, F.concat(F.slice(counts, F.lit(1), last), F.array(count))).otherwise(counts).alias("counts"),
            F.when(name == "pre", F.when(closing, F.lit(0)).otherwise(F.lit(1))).otherwise(pre).alias("pre"),
            F.concat(
                state["out"],
                F.array(
                    F.when((name == "pre") & ~closing, F.concat(F.lit("<p>" + CLOSE_MARK * 4), fixed(F.regexp_replace(rest, r"\A\r?\n", ""))))
                    .when(name == "pre", F.concat(F.lit("<p>"), rest))
                    .when(pre > 0, F.concat(F.regexp_extract(piece, r"\A<[^>]*>", 0), fixed(rest)))
                    .when(is_list, F.concat(border, rest)).when(is_item, item).when((name == "li") & closing, rest).otherwise(piece)
                ),
            ).alias("out"),
        )

    return F.array_join(F.aggregate(_tag_pieces(escape_marks(html)), start, step)["out"], "")


def _restored(markdown: Column) -> Column:
    lines = F.regexp_replace(markdown, f"[ \\t{CLOSE_MARK}]*{OPEN_MARK}", "\n")
    return unescape_marks(F.regexp_replace(F.replace(lines, F.lit(CLOSE_MARK), F.lit(" ")), r"\n{3,}", "\n\n"))


def html_to_markdown(html: Column, selectors: list[str] | None = None) -> Column:
    """Markdown with headings, links, images, emphasis, lists and tables; lines are not wrapped."""
    body = F.regexp_replace(remove_unwanted(html, selectors), tag_pattern("head"), "")
    body = F.regexp_replace(body, r"(?i)<!doctype[^>]*>", "")

    def converted(page: Column) -> Column:
        parts = F.split(page, r"(?i)(?=<table\b)|(?<=</table>)")
        mixed = F.transform(
            parts,
            lambda p: F.when(
                p.rlike(r"(?i)\A<table\b"), F.concat(F.lit("\n\n"), table_markdown(p), F.lit("\n\n"))
            ).otherwise(_apply(p, MARKDOWN_RULES)),
        )
        return F.when(page.rlike(r"(?i)<table\b"), F.array_join(mixed, "")).otherwise(_apply(page, MARKDOWN_RULES))

    def written(page: Column) -> Column:
        plain = lambda p: _apply(let(converted(p), unescape), TIDY_RULES)
        return F.when(page.rlike(STRUCTURED), _restored(let(_structured(page), plain))).otherwise(plain(page))

    return strip(let(let(body, _quoted_attributes), written))


def is_valid_content(text: Column, min_length: int = 100) -> Column:
    return F.coalesce((F.length(text) >= min_length) & has_content(text), F.lit(False))


def url_origin(url: Column) -> Column:
    return F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def url_host(url: Column) -> Column:
    """Host with its port, as written."""
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    closing = F.when(path.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.array_join(kept, "/"), closing)
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.when(joined == "", F.lit("/")).otherwise(joined)).otherwise(path)


def absolute_url(base: Column, link: Column) -> Column:
    """Resolve a link against the page it stands on."""
    origin = url_origin(base)
    folder = F.regexp_extract(F.regexp_replace(url_path(base), r"\?.*\z", ""), r"\A(.*/)", 1)
    tail = F.regexp_extract(link, r"([?#].*)\z", 1)
    path = F.regexp_replace(link, r"[?#].*\z", "")
    return (
        F.when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"\A([^:]*:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, resolve_dots(path), tail))
        .when(link.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*\z", ""), link))
        .otherwise(F.concat(origin, resolve_dots(F.concat(folder, path)), tail))
    )


def page_links(html: Column, base: Column) -> Column:
    """Distinct absolute links of a page's anchors, as an array."""
    visible = F.regexp_replace(html, COMMENT, "")
    for tag in ("script", "style"):
        visible = F.regexp_replace(visible, tag_pattern(tag), "")
    quoted = F.regexp_extract_all(
        visible, F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1)
    )
    targets = F.transform(quoted, lambda h: strip(unescape(F.regexp_replace(h, r"""\A["']|["']\z""", ""))))
    useful = F.filter(targets, lambda h: (h != "") & ~h.rlike(r"\A(?:#|javascript:|mailto:|tel:)"))
    return F.array_distinct(F.transform(useful, lambda h: absolute_url(base, h)))


def extract_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row per page and distinct link."""
    kept = [c for c in pages.columns if c != html]
    return explode_items(pages, page_links(F.col(html), F.col(url)), "link", keep=kept)


def normalize_url(url: Column) -> Column:
    """Without fragment; null unless http or https."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*\z", ""), r"\?\z", "")
    scheme = F.lower(F.regexp_extract(bare, r"\A([A-Za-z]+)://", 1))
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.regexp_replace(bare, r"\A[A-Za-z]+", "")))


def should_crawl(url: Column, host: Column | None, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Same host (when one is given), no exclude pattern, and an include pattern if there are any."""
    normal = normalize_url(url)
    keep = normal.isNotNull()
    if host is not None:
        keep = keep & (url_host(normal) == host)
    for pattern in exclude or []:
        keep = keep & ~normal.rlike(pattern)
    if include:
        keep = keep & normal.rlike("|".join(f"(?:{p})" for p in include))
    return F.coalesce(keep, F.lit(False))


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """Add ``allowed``: the longest matching prefix decides, allow wins ties, no rule allows.

    A host's rules for the agent itself hide those for ``*``.

    ``rules`` has host, agent, prefix, allow. Rules of one host become one row (a robots file is small), so urls are
    never multiplied by rules; hosts with very many urls are spread by salt.
    """
    own = rules.filter(F.col("agent").isin("*", agent))
    per_host = own.groupBy("host").agg(
        F.collect_set(F.struct(F.length("prefix").alias("n"), F.col("allow").alias("allow"), F.col("prefix").alias("prefix"), F.col("agent").alias("agent"))).alias("__rules")
    ).withColumn("__named", F.exists("__rules", lambda r: r["agent"] != "*"))
    joined = salted_join(urls.withColumn("host", url_host(F.col(url))), per_host, ["host"], how="left")
    group = F.filter("__rules", lambda r: ~F.col("__named") | (r["agent"] != "*"))
    matching = F.filter(group, lambda r: F.col(url).isNotNull() & url_path(F.col(url)).startswith(r["prefix"]))
    best = F.array_max(matching)
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("__rules", "__named")


def clean_pages(pages: DataFrame, selectors: list[str] | None = None) -> DataFrame:
    """Title, markdown, its length and whether it is worth keeping."""
    rows = pages.withColumn("title", page_title(F.col("html"))).withColumn("markdown", html_to_markdown(F.col("html"), selectors))
    return rows.withColumn("content_length", F.length("markdown")).withColumn("valid", is_valid_content(F.col("markdown")))


def page_documents(cleaned: DataFrame, crawled_at: Column) -> DataFrame:
    """Pages as documents with a header block; the URL is the source path, so equal titles stay apart."""
    header = F.concat(
        F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n**Source:** "), F.col("url"),
        F.lit("\n\n**Crawled:** "), F.date_format(crawled_at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("\n\n---\n\n"), F.col("markdown"),
    )
    return cleaned.filter("valid").select("url", "title", header.alias("text"))
