"""Named SQL sources: Parquet tables or external databases registered as views, queried through Spark SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quillstack.session import load_table
from quillstack.sources.files import export_result


@dataclass
class SqlSource:
    """A set of tables queried together.

    ``folder`` + ``tables`` name Parquet tables. ``jdbc_url`` reads the tables of an external database instead;
    ``partitioning`` gives per table (column, lower, upper, partitions) so that the read runs in parallel.
    """

    folder: str | None = None
    tables: list[str] = field(default_factory=list)
    jdbc_url: str | None = None
    jdbc_properties: dict[str, str] = field(default_factory=dict)
    partitioning: dict[str, tuple[str, int, int, int]] = field(default_factory=dict)

    def frame(self, spark: SparkSession, table: str) -> DataFrame:
        if self.jdbc_url is None:
            return load_table(spark, self.folder, table)
        reader = spark.read.format("jdbc").options(url=self.jdbc_url, dbtable=table, fetchsize="10000")
        reader = reader.options(**self.jdbc_properties)
        if table in self.partitioning:
            column, lower, upper, parts = self.partitioning[table]
            reader = reader.options(
                partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts)
            )
        return reader.load()

    def register(self, spark: SparkSession) -> None:
        for table in self.tables:
            self.frame(spark, table).createOrReplaceTempView(table)


def run_sql(spark: SparkSession, source: SqlSource, query: str, output_path: str | None = None) -> DataFrame:
    """Run ``query`` over the source's tables; with ``output_path`` the rows are also exported by the executors."""
    source.register(spark)
    result = spark.sql(query)
    if output_path:
        export_result(result, output_path)
    return result
