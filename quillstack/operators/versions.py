"""Version candidates, current-version pointers, cascade clean-up, owner backfill, prompt versions, migration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.functions.windows import salted_join
from quillstack.operators.collections import delete_where
from quillstack.operators.upsert import delete_keys, upsert
from quillstack.schemas import TABLE_KEYS


def semantic_id(step: str, method: Column, technical: Column) -> Column:
    return F.concat_ws("_", F.lit(step), method, F.substring(technical, 1, 8))


def _listed(candidates: DataFrame) -> DataFrame:
    """Candidates as lists and promotions read them: none is more than a candidate, and nobody is on record for it."""
    return candidates.withColumn("state", F.lit("candidate")).withColumn("operator", F.lit("unknown"))


def parse_candidates(parses: DataFrame) -> DataFrame:
    return _listed(parses.select(
        "collection", "doc_id", F.col("parse_hash").alias("technical_id"),
        semantic_id("parse", F.col("parser"), F.col("parse_hash")).alias("semantic_id"), "created_at",
    ))


def chunk_candidates(chunks: DataFrame) -> DataFrame:
    """Per document and parse: chunks, whole mean length and first creation time."""
    return _listed(chunks.groupBy("collection", "doc_id", F.col("parse_hash").alias("technical_id")).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.avg(F.length("text")).cast("int").alias("mean_length"),
        F.min("created_at").alias("created_at"),
    ).withColumn("semantic_id", semantic_id("chunk", F.lit(None).cast("string"), F.col("technical_id"))))


def embed_candidates(embeddings: DataFrame, model_tag: str | None = None) -> DataFrame:
    """Per document, model and parse: vectors, their dimension and first creation time; of one model's table if a tag is given."""
    rows = embeddings if model_tag is None else embeddings.filter(F.col("model_tag") == model_tag)
    created = F.min("created_at") if "created_at" in rows.columns else F.lit(None).cast("timestamp")
    found = rows.groupBy("collection", "doc_id", "model", F.col("parse_hash").alias("technical_id")).agg(
        F.count(F.lit(1)).alias("vectors"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimension"), created.alias("created_at")
    )
    return _listed(found.withColumn("semantic_id", semantic_id("embed", F.col("model"), F.col("technical_id"))))


def list_candidates(
    candidates: DataFrame, order: str, descending: bool = True, limit: int | None = None, state: str | None = None
) -> DataFrame:
    """Candidates by time with the total before the limit; without a limit, or one of 0 or less, all."""
    rows = candidates if state is None else candidates.filter(F.col("state") == state)
    rows = rows.withColumn("total", rows.agg(F.count(F.lit(1))).scalar())
    ids = [c for c in ("collection", "doc_id", "technical_id") if c in rows.columns]
    rows = rows.orderBy(F.col(order).desc() if descending else F.col(order).asc(), *ids)
    return rows.limit(limit) if limit is not None and limit > 0 else rows


POINTER_KEYS = TABLE_KEYS["main_pointers"]


def set_pointers(pointers: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert pointers; a missing model tag is the empty tag, and ``created_at`` of an existing pointer stays."""
    tagged = new.withColumn("model_tag", F.coalesce("model_tag", F.lit("")))
    return upsert(pointers, tagged, POINTER_KEYS, order=["updated_at", "technical_id"], keep=["created_at"])


def get_pointer(pointers: DataFrame, collection: str, doc_id, step: str, model_tag: str | None = None) -> DataFrame:
    return pointers.filter(
        (F.col("collection") == collection) & (F.col("doc_id") == doc_id) & (F.col("step_type") == step)
        & (F.col("model_tag") == (model_tag or ""))
    )


def list_pointers(pointers: DataFrame, collection: str, limit: int | None = None) -> DataFrame:
    """Pointers of a collection, newest first; without a limit, all."""
    rows = pointers.filter(F.col("collection") == collection).orderBy(F.col("updated_at").desc(), "doc_id", "step_type", "model_tag")
    return rows if limit is None else rows.limit(limit)


def delete_pointers(pointers: DataFrame, doomed: DataFrame) -> DataFrame:
    return delete_keys(pointers, doomed.withColumn("model_tag", F.coalesce("model_tag", F.lit(""))), POINTER_KEYS)


def resolve_ids(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Technical id for each requested id (columns collection, doc_id, selected): technical match first, then semantic."""
    keys = ["collection", "doc_id"]
    both = candidates.select(*keys, "technical_id", F.col("technical_id").alias("selected"), F.lit(0).alias("__p")).unionByName(
        candidates.select(*keys, "technical_id", F.col("semantic_id").alias("selected"), F.lit(1).alias("__p"))
    )
    found = requests.join(both, [*keys, "selected"], "left")
    return found.groupBy(*keys, "selected").agg(
        F.min_by("technical_id", F.struct("__p", "technical_id")).alias("technical_id")
    )


def cascade_conditions(
    scope: str, collection: str, doc_id, old_parse: str | None = None, new_parse: str | None = None, model_tag: str | None = None
) -> dict[str, Column]:
    """Rows each table loses, children first.

    Scope parse drops what belongs to the old parse, or to any parse but the new one when that is known; scope chunk
    leaves the parses. A model tag limits the embeddings.
    """
    document = (F.col("collection") == collection) & (F.col("doc_id") == doc_id)
    if new_parse is not None:
        stale = document & (F.col("parse_hash") != new_parse)
    elif old_parse is not None:
        stale = document & (F.col("parse_hash") == old_parse)
    else:
        stale = None
    if scope == "document":
        conditions = {t: document for t in ("embeddings", "chunks", "parses", "main_pointers", "documents")}
    elif scope == "parse":
        touched = ["embeddings", "chunks", "parses"] if new_parse is not None else ["embeddings", "chunks"]
        conditions = {t: stale for t in touched} if stale is not None else {}
    elif scope == "chunk":
        touched = ["embeddings", "chunks"] if new_parse is not None else ["embeddings"]
        conditions = {t: stale for t in touched} if stale is not None else {}
    elif scope == "embeddings":
        conditions = {"embeddings": document}
    elif scope == "pointers":
        conditions = {"main_pointers": document}
    else:
        raise ValueError(f"unknown scope {scope}")
    if model_tag and "embeddings" in conditions:
        conditions["embeddings"] = conditions["embeddings"] & (F.col("model_tag") == model_tag)
    return conditions


def cascade_preview(tables: dict[str, DataFrame], conditions: dict[str, Column]) -> DataFrame:
    """Rows per table that a clean-up would delete."""
    counts = None
    for name, condition in conditions.items():
        if name in tables:
            _, part = delete_where({name: tables[name]}, condition)
            counts = part if counts is None else counts.unionByName(part)
    return counts


def cascade_delete(tables: dict[str, DataFrame], conditions: dict[str, Column]) -> dict[str, DataFrame]:
    """Next state of every table; tables without a condition stay as they are."""
    out = dict(tables)
    for name, condition in conditions.items():
        if name in tables:
            out[name] = delete_where({name: tables[name]}, condition)[0][name]
    return out


@dataclass
class Promotion:
    """Outcome of a promotion: the planned deletions, what has to be done again, and with ``confirm`` the next tables."""

    technical_id: str
    semantic_id: str | None
    operator: str
    plan: DataFrame
    notes: list[str]
    tables: dict[str, DataFrame] | None

    @property
    def promoted(self) -> bool:
        return self.tables is not None


#: Longest name of an operator.
OPERATOR_LENGTH = 32


def promote(
    tables: dict[str, DataFrame], candidates: DataFrame, step: str, collection: str, doc_id, selected: str, at: Column,
    confirm: bool = False, model_tag: str | None = None, operator: str = "unknown",
) -> Promotion:
    """Make a version the current one: resolve it, plan the clean-up of its rivals, and on ``confirm`` apply it.

    An embedding version is promoted within one model (``model_tag``): the document's vectors of that model that come
    from other parses go. The plan has a row for each table.
    """
    scope = {"parse": "parse", "chunk": "chunk", "embed": "embeddings"}.get(step)
    if scope is None:
        raise ValueError(f"unknown step {step}")
    if step == "embed" and not model_tag:
        raise ValueError("an embedding version needs a model tag")
    if len(operator) > OPERATOR_LENGTH:
        raise ValueError(f"the operator's name is longer than {OPERATOR_LENGTH} characters")
    spark = candidates.sparkSession
    wanted = spark.range(1).select(F.lit(collection).alias("collection"), F.lit(doc_id).alias("doc_id"), F.lit(selected).alias("selected"))
    one = candidates.filter((F.col("collection") == collection) & (F.col("doc_id") == doc_id))
    found = resolve_ids(wanted, one).first()
    if found is None or found["technical_id"] is None:
        raise ValueError(f"no {step} version {selected}")
    technical = found["technical_id"]
    chosen = one.filter(F.col("technical_id") == technical).orderBy((F.col("semantic_id") == selected).desc(), "semantic_id").limit(1)
    conditions = cascade_conditions(scope, collection, doc_id, new_parse=technical, model_tag=model_tag)
    if step == "embed":
        conditions["embeddings"] = conditions["embeddings"] & (F.col("parse_hash") != technical)
    lost = cascade_preview(tables, conditions).collect()  # a row for each table
    plan = spark.createDataFrame(lost, "table_name string, rows long")
    counts = {r["table_name"]: r["rows"] for r in lost}
    notes = []
    if step == "parse" and counts.get("chunks", 0) > 0:
        notes.append("Requires re-chunk/embed")
    elif step == "chunk" and counts.get("embeddings", 0) > 0:
        notes.append("Requires re-embed")
    semantic = chosen.select("semantic_id").first()[0]
    if not confirm:
        return Promotion(technical, semantic, operator, plan, notes, None)
    after = cascade_delete(tables, conditions)
    row = chosen.select(
        "collection", "doc_id", F.lit(step).alias("step_type"), F.lit(model_tag).cast("string").alias("model_tag"), "semantic_id",
        "technical_id", F.lit(operator).alias("operator"), at.alias("created_at"), at.alias("updated_at"),
    )
    pointers = tables["main_pointers"]
    if "operator" not in pointers.columns:
        pointers = pointers.withColumn("operator", F.lit(None).cast("string"))
    after["main_pointers"] = set_pointers(pointers, row)
    return Promotion(technical, semantic, operator, plan, notes, after)


def backfill_owner(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Fill missing owners from the documents table; a document with very many rows is spread by salt."""
    owners = documents.filter(F.col("user_id").isNotNull()).groupBy("collection", "doc_id").agg(F.min("user_id").alias("__owner"))
    joined = salted_join(rows, owners, ["collection", "doc_id"], how="left")
    return joined.withColumn("__before", F.col("user_id")).withColumn("user_id", F.coalesce("user_id", "__owner")).drop("__owner")


def backfill_report(filled: DataFrame) -> DataFrame:
    return filled.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("__before").isNull() & F.col("user_id").isNotNull()).alias("backfilled"),
        F.count_if(F.col("user_id").isNull()).alias("skipped"),
    )


PROMPT = ["collection", "name"]


def with_latest(log: DataFrame, tie: str = "id") -> DataFrame:
    """Mark the highest version per prompt. Names with very many versions are spread by salt."""
    newest = log.groupBy(*PROMPT).agg(F.max(F.struct("version", tie)).alias("__top"))
    marked = salted_join(log.drop("is_latest"), newest, PROMPT)
    return marked.withColumn("is_latest", F.struct("version", tie) == F.col("__top")).drop("__top")


def add_versions(log: DataFrame, new: DataFrame, tie: str = "id") -> DataFrame:
    """Append prompts (one row per prompt) with the next version number and mark the latest."""
    top = log.groupBy(*PROMPT).agg(F.max("version").alias("__max"))
    numbered = new.join(top, PROMPT, "left").withColumn("version", F.coalesce(F.col("__max") + 1, F.lit(1))).drop("__max")
    return with_latest(log.drop("is_latest").unionByName(numbered, allowMissingColumns=True), tie)


def read_prompts(log: DataFrame, version: int | None = None, tie: str = "id") -> DataFrame:
    """Latest version per prompt, or a given one."""
    if version is not None:
        return log.filter(F.col("version") == version)
    row = F.struct(*log.columns)
    return log.groupBy(*PROMPT).agg(F.max_by(row, F.struct("version", tie)).alias("__row")).select("__row.*")


def list_prompts(
    log: DataFrame, name_part: str | None = None, latest_only: bool = False, limit: int | None = None, metadata: dict | None = None,
    tie: str = "id",
) -> DataFrame:
    rows = read_prompts(log, tie=tie) if latest_only else log
    if name_part:
        rows = rows.filter(F.contains(F.col("name"), F.lit(name_part)))
    for key, value in (metadata or {}).items():
        rows = rows.filter(F.try_variant_get(F.try_parse_json("metadata"), f"$.{key}", "string") == str(value))
    rows = rows.orderBy(*PROMPT, F.col("version").desc(), tie)
    return rows if limit is None else rows.limit(limit)


def delete_versions(log: DataFrame, doomed: DataFrame, tie: str = "id") -> DataFrame:
    """Drop versions; the next highest becomes the latest."""
    return with_latest(delete_keys(log, doomed, [*PROMPT, "version"]), tie)


def migrate(df: DataFrame, target: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Bring a table to the target schema: missing columns are null or their default, other types are cast leniently."""
    present = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for f in target.fields:
        value = F.lit(None).cast(f.dataType) if f.name not in present else F.col(f.name)
        if f.name in present and present[f.name] != f.dataType:
            value = value.try_cast(f.dataType)
        if f.name in (defaults or {}):
            value = F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType))
        columns.append(value.alias(f.name))
    return df.select(*columns)


def migration_plan(df: DataFrame, target: T.StructType) -> DataFrame:
    """Dry run: one row per column that would be added or cast, with the values a cast would lose."""
    present = {f.name: f.dataType for f in df.schema.fields}
    plan = None
    for f in target.fields:
        if f.name in present and present[f.name] == f.dataType:
            continue
        if f.name not in present:
            action, lost = "add", F.lit(0).cast("long")
        else:
            action, lost = "cast", F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
        part = df.agg(lost.alias("lost")).select(F.lit(f.name).alias("column_name"), F.lit(action).alias("action"), "lost")
        plan = part if plan is None else plan.unionByName(part)
    return plan
