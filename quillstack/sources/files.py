"""Reading, writing, listing and classifying files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions.text import basename, extension
from quillstack.sources.listing import list_folder

# Extension -> file type.
EXTENSION_TYPES = {
    ".txt": "txt", ".md": "md", ".json": "json", ".html": "html", ".htm": "html", ".pdf": "pdf", ".doc": "doc",
    ".docx": "docx", ".csv": "csv", ".xlsx": "xlsx", ".ppt": "ppt", ".pptx": "pptx", ".jpg": "image",
    ".jpeg": "image", ".png": "image", ".gif": "image", ".bmp": "image", ".tiff": "image", ".tif": "image",
}

# Parsers able to read an extension.
PARSERS_BY_EXTENSION = {
    ".pdf": ["deepdoc", "pymupdf", "pdfplumber", "unstructured", "pypdf"],
    ".docx": ["deepdoc", "unstructured"],
    ".doc": ["unstructured"],
    ".pptx": ["unstructured"],
    ".ppt": ["unstructured"],
    ".txt": ["unstructured", "deepdoc"],
    ".md": ["unstructured", "deepdoc"],
    ".json": ["unstructured", "deepdoc"],
    ".xlsx": ["unstructured", "deepdoc"],
    ".xls": ["unstructured", "deepdoc"],
    ".csv": ["deepdoc"],
    ".html": ["deepdoc"],
}


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header and a declared schema, so no extra pass infers types."""
    return (
        spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding)
        .option("multiLine", True).option("escape", '"').csv(path)
    )


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8", mode: str = "errorifexists") -> None:
    (
        df.write.mode(mode).option("header", True).option("sep", sep).option("encoding", encoding)
        .option("escape", '"').option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    )


def read_json(spark: SparkSession, path: str, schema: str, whole_file: bool = False) -> DataFrame:
    """JSON Lines, or one JSON document per file with ``whole_file``."""
    return spark.read.schema(schema).option("multiLine", whole_file).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines; null fields are written."""
    (
        df.write.mode(mode).option("ignoreNullFields", False)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    )


def export_result(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write a query result in the format named by the path's extension."""
    lowered = path.lower()
    if lowered.endswith(".csv"):
        write_csv(df, path, mode=mode)
    elif lowered.endswith((".json", ".jsonl", ".ndjson")):
        write_json(df, path, mode=mode)
    elif lowered.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported export format: {path}")
    return path


def decode_bytes(content: Column) -> Column:
    """UTF-8 with or without a byte order mark, else Latin-1."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"\A\x{feff}", "")


def read_text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: path and decoded text."""
    return list_binary(spark, path, glob).select("path", decode_bytes(F.col("content")).alias("text"))


def list_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    )


def list_files(spark: SparkSession, path: str, show_hidden: bool = False, glob: str = "*") -> DataFrame:
    """Path, name, size and time of every file below ``path``; contents are not read.

    Hidden names (with a leading dot or underscore) are beyond Spark's file sources and come from ``listing``.
    """
    if show_hidden:
        return list_folder(spark, path, True, glob).drop("hidden")
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    files = list_binary(spark, path, glob).select(
        "path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")
    )
    return files


def file_type(path: Column) -> Column:
    """Type of a file by its extension; null when the extension is not known."""
    mapping = F.create_map(*[F.lit(x) for pair in EXTENSION_TYPES.items() for x in pair])
    return F.try_element_at(mapping, extension(path))


def with_file_type(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``file_type`` and, for unknown extensions, ``error``."""
    kind = file_type(F.col(path))
    return df.withColumn("file_type", kind).withColumn(
        "error", F.when(kind.isNull(), F.concat(F.lit("Unsupported file type: "), extension(F.col(path))))
    )


def detect_format(content: Column, path: Column) -> Column:
    """Format from the leading bytes, else from the extension.

    Office files are ZIP archives whose entry names stand uncompressed in the archive, so their presence is
    tested on the bytes; no archive has to be opened.
    """
    head = F.hex(F.substring(content, 1, 8))
    ext = extension(path)
    body = F.decode(content, "ISO-8859-1")
    typed = F.contains(body, F.lit("[Content_Types].xml"))
    by_extension = F.when(ext == "", F.lit("unknown")).otherwise(F.regexp_replace(ext, r"\A\.", ""))
    return (
        F.when(head.startswith("504B") & typed & F.contains(body, F.lit("word/document.xml")), F.lit("docx"))
        .when(head.startswith("504B") & typed & F.contains(body, F.lit("xl/workbook.xml")), F.lit("xlsx"))
        .when(head.startswith("504B") & typed & F.contains(body, F.lit("ppt/presentation.xml")), F.lit("pptx"))
        .when((head == "D0CF11E0A1B11AE1") & ext.isin(".xlsx", ".xls"), F.lit("xls"))
        .when((head == "D0CF11E0A1B11AE1") & ext.isin(".pptx", ".ppt"), F.lit("ppt"))
        .when(head == "D0CF11E0A1B11AE1", F.lit("doc"))
        .when(head.startswith("25504446"), F.lit("pdf"))
        .otherwise(by_extension)
    )


def parser_is_compatible(path: Column, method: Column, allow_mixed: bool = False) -> Column:
    """True when ``method`` can read the file's extension (the table has a dozen fixed entries, so it is a literal map)."""
    if allow_mixed:
        return F.lit(True)
    entries = []
    for ext, parsers in PARSERS_BY_EXTENSION.items():
        entries += [F.lit(ext), F.array(*[F.lit(p) for p in parsers])]
    supported = F.try_element_at(F.create_map(*entries), extension(path))
    return F.coalesce(F.array_contains(supported, method), F.lit(False))


def parser_violations(df: DataFrame, path: str = "path", method: str = "method") -> DataFrame:
    """Rows whose parser cannot read their file type."""
    return df.filter(~parser_is_compatible(F.col(path), F.col(method)))


def register_found(
    listing: DataFrame, registry: DataFrame, registered_at: Column, path: str = "path", root: str = r"(?:\A|/)user_([0-9]+)/"
) -> DataFrame:
    """The next registry: files it does not know are added with name, type, size and the owner whose folder they lie in.

    A file outside every owner's folder is left out. Running it again adds nothing.
    """
    owner = F.regexp_extract(F.col(path), root, 1)
    found = unregistered_files(listing, registry, path).withColumn("user_id", F.when(owner != "", owner.cast("long"))).filter("user_id IS NOT NULL")
    rows = found.select(
        path, basename(F.col(path)).alias("name"), file_type(F.col(path)).alias("file_type"),
        (F.col("size") if "size" in listing.columns else F.lit(None).cast("long")).alias("size"), "user_id", registered_at.alias("registered_at"),
    ).dropDuplicates([path])
    return registry.unionByName(rows, allowMissingColumns=True)


def unregistered_files(listing: DataFrame, registry: DataFrame, path: str = "path") -> DataFrame:
    """Stored files the registry does not know."""
    return listing.join(registry.select(path).distinct(), path, "left_anti")
