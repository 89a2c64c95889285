"""Session settings, table loading and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings the operators rely on; everything else stays at the cluster's own values.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def apply_session_conf(spark: SparkSession) -> SparkSession:
    """Set the run-time settings on an existing session and return it."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "quillstack", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session. ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return apply_session_conf(builder.getOrCreate())


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``folder/name.parquet``; zone-less timestamps become UTC timestamps."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by ``key`` to as many tasks as ``quillstack.text.partitions`` asks for; unset, the scan's splits stay.

    For text tables that lie in fewer files than there are cores: text expressions cost more than one shuffle.
    """
    parts = df.sparkSession.conf.get("quillstack.text.partitions", None)
    return df.repartition(int(parts), key) if parts else df


def _checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    root = context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="quillstack-")
    context.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir`` (a temporary folder in local mode only)."""
    return f"{_checkpoint_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    root = _checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)
