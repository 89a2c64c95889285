"""Quantised vector search with exact re-ranking, over indexed rows and the rows written since.

Indexed rows lie in cells, one for each centroid, with a code for each row: for each stretch of its difference from the
centroid, the nearest of up to 256 vectors of that stretch's code book. A search looks up the distance of each code in a
table made for the query and the cell, keeps the best ``k * refine`` rows, and ranks those by their exact distance.

Rows upserted or deleted after a build are change batches: the newest change of an id hides the indexed row, and live
changed rows are searched exactly. ``maintain`` folds them in when the index plan's thresholds ask for it, and splits cells
that have grown over twice their share. Centroids and code books are trained on a bounded sample; every row is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.operators.vector import (
    REINDEX_UNINDEXED_RATIO, REINDEX_UNINDEXED_ROWS, REINDEX_UPSERTS, distance, filter_condition, query_literal, score, split_valid,
)
from quillstack.sources.snapshots import SnapshotTable

#: Rows that centroids and code books are trained on, entries of a code book, and rounds of training.
TRAIN_ROWS, BOOK, ROUNDS = 50_000, 256, 12


def trained(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Up to ``k`` centroids of a bounded sample, the first ones far from each other; a centroid that loses its rows stays."""
    unique = np.unique(rows, axis=0)
    if len(unique) <= k:
        return unique
    rnd = np.random.default_rng(seed)
    chosen = [unique[rnd.integers(len(unique))]]
    gap = ((unique - chosen[0]) ** 2).sum(1)
    for _ in range(k - 1):
        chosen.append(unique[rnd.choice(len(unique), p=gap / gap.sum())])
        gap = np.minimum(gap, ((unique - chosen[-1]) ** 2).sum(1))
        if not gap.any():
            break
    out = np.array(chosen)
    for _ in range(rounds):
        own = nearest(rows, out)
        counts = np.bincount(own, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, own, rows)
        out[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return out


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The place of the nearest centroid of each row, ties to the first."""
    return ((centroids**2).sum(1) - 2 * (rows @ centroids.T)).argmin(1)


@dataclass
class Quantizer:
    """Centroids and code books: a few thousand vectors and 256 for each stretch, small enough for every task."""

    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.cuts = np.cumsum([0, *(b.shape[1] for b in self.books)]).tolist()

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each vector; code bytes are signed, as Spark's are."""
        cell = nearest(vectors, self.centroids)
        rest = vectors - self.centroids[cell]
        codes = [nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]
        return cell, (np.stack(codes, axis=1) - 128).astype(np.int8)

    def tables(self, query: np.ndarray, cells: list[int]) -> list[tuple[int, list[float]]]:
        """For each cell the squared distance of every code book entry from the query's difference to its centroid."""
        out = []
        for cell in cells:
            rest = query - self.centroids[cell]
            table = np.full((len(self.books), BOOK), np.inf)
            for j, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
                table[j, : len(book)] = ((book - rest[a:b]) ** 2).sum(1)
            out.append((cell, table.ravel().tolist()))
        return out

    def rows(self) -> list[tuple[str, int, int, list[float]]]:
        out = [("cell", 0, i, c.tolist()) for i, c in enumerate(self.centroids)]
        return out + [("book", j, i, c.tolist()) for j, book in enumerate(self.books) for i, c in enumerate(book)]

    @staticmethod
    def of(rows: list[Row]) -> Quantizer:
        cells = [r["v"] for r in sorted((r for r in rows if r["kind"] == "cell"), key=lambda r: r["place"])]
        books: dict[int, list] = {}
        for r in sorted((r for r in rows if r["kind"] == "book"), key=lambda r: (r["stretch"], r["place"])):
            books.setdefault(r["stretch"], []).append(r["v"])
        return Quantizer(np.array(cells), [np.array(books[j]) for j in sorted(books)])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _sample(rows: DataFrame, vector: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows, chosen by a hash of the id, so that a rerun trains on the same rows."""
    count = rows.count()
    if count > most:
        rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < max(1, most * 1_000_000 // count))
    return rows.select(F.col(vector).cast("array<double>").alias("v"))


def train(rows: DataFrame, vector: str, key: str, cells: int, stretches: int, train_rows: int = TRAIN_ROWS) -> Quantizer:
    """Centroids from the sample, then one task for each stretch trains its code book on the sample's differences."""
    spark = rows.sparkSession
    sample = np.array([r["v"] for r in _sample(rows, vector, key, train_rows).collect()])  # bounded by train_rows
    centroids = trained(sample, cells)
    rest = sample - centroids[nearest(sample, centroids)]
    cuts = np.linspace(0, rest.shape[1], min(stretches, rest.shape[1]) + 1).astype(int).tolist()
    shared = spark.sparkContext.broadcast(rest)

    def book(parts):
        for part in parts:
            for j in part["j"]:
                for i, c in enumerate(trained(shared.value[:, cuts[j] : cuts[j + 1]], BOOK)):
                    yield pd.DataFrame({"kind": ["book"], "stretch": [j], "place": [i], "v": [c.tolist()]})

    numbers = spark.range(len(cuts) - 1, numPartitions=len(cuts) - 1).select(F.col("id").cast("int").alias("j"))
    books = numbers.mapInPandas(book, "kind string, stretch int, place int, v array<double>").collect()
    return Quantizer.of([*(Row(kind="cell", stretch=0, place=i, v=c.tolist()) for i, c in enumerate(centroids)), *books])


def encoded(rows: DataFrame, quantizer: Quantizer, vector: str) -> DataFrame:
    """``rows`` with their cell and code."""
    shared = rows.sparkSession.sparkContext.broadcast(quantizer)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.ArrayType(T.ByteType()))])

    def run(parts):
        for part in parts:
            if len(part):
                cell, code = shared.value.encode(_matrix(part[vector]))
                yield part.assign(cell=cell.astype("int32"), code=list(code))

    return rows.mapInPandas(run, schema)


@dataclass
class VectorIndex:
    """An index below ``path``: snapshots of coded rows with their quantiser, and numbered change batches."""

    spark: SparkSession
    path: str
    key: str
    vector: str = "vector"

    def __post_init__(self) -> None:
        self.rows_table = SnapshotTable(self.spark, f"{self.path}/rows", ["cell"])
        self.models = SnapshotTable(self.spark, f"{self.path}/models")
        self.changes = SnapshotTable(self.spark, f"{self.path}/changes", keep=1 << 30)

    @staticmethod
    def build(rows: DataFrame, path: str, key: str, vector: str = "vector", cells: int = 64, stretches: int = 8) -> VectorIndex:
        """Index every row with a usable vector of the first dimension met; ids are to be unique."""
        index = VectorIndex(rows.sparkSession, path, key, vector)
        first = rows.filter(F.size(vector) > 0).agg(F.min(F.size(vector))).first()[0]
        if first is None:
            raise ValueError("no vectors to index")
        good, _ = split_valid(rows, first, vector)
        quantizer = train(good, vector, key, cells, stretches)
        index._store(encoded(good, quantizer, vector), quantizer, 0)
        return index

    def _store(self, rows: DataFrame, quantizer: Quantizer, folded: int) -> None:
        """The model first: a snapshot counts when its rows are complete."""
        version = max(self.rows_table.next_version(), self.models.next_version())
        model = self.spark.createDataFrame([(*r, folded) for r in quantizer.rows()], "kind string, stretch int, place int, v array<double>, folded long")
        self.models.write(model, version)
        # Several writers for each cell, so that a large one does not wait for one task.
        self.rows_table.write(rows.repartition("cell", F.pmod(F.xxhash64(self.key), F.lit(8))), version)

    def model(self) -> tuple[int, Quantizer, int]:
        """The newest version, its quantiser and the number of the last change batch that it holds."""
        version = self.rows_table.versions()[-1]
        rows = self.models.read(version).collect()
        return version, Quantizer.of(rows), rows[0]["folded"]

    def upsert(self, rows: DataFrame) -> None:
        """Add or replace rows; those whose vector cannot be stored are refused with their ids."""
        _, quantizer, _ = self.model()
        good, bad = split_valid(rows, quantizer.centroids.shape[1], self.vector)
        refused = [r[0] for r in bad.select(self.key).limit(10).collect()]
        if refused:
            raise ValueError(f"vectors that cannot be stored, of {self.key} {refused}")
        self.changes.write(good.withColumn("gone", F.lit(False)))

    def delete(self, ids: DataFrame) -> None:
        self.changes.write(ids.select(self.key).distinct().withColumn("gone", F.lit(True)))

    def _changed(self, folded: int) -> DataFrame | None:
        """The newest change of each id since ``folded``."""
        batches = [n for n in self.changes.versions() if n > folded]
        if not batches:
            return None
        columns = self.rows_table.read().drop("cell", "code").schema
        out = None
        for n in batches:
            part = self.changes.read(n)
            part = part.select(*[F.col(c.name) if c.name in part.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in columns], "gone", F.lit(n).alias("batch"))
            out = part if out is None else out.unionByName(part)
        row = F.struct(*columns.names, "gone")
        return out.groupBy(F.col(self.key).alias("__key")).agg(F.max_by(row, "batch").alias("row")).select("row.*")

    def _parts(self) -> tuple[DataFrame, DataFrame | None, Quantizer]:
        """Indexed rows that no change hides, live changed rows, and the quantiser."""
        version, quantizer, folded = self.model()
        rows, changed = self.rows_table.read(version), self._changed(folded)
        if changed is None:
            return rows, None, quantizer
        return rows.join(changed.select(self.key), self.key, "left_anti"), changed.filter("NOT gone").drop("gone"), quantizer

    def rows(self) -> DataFrame:
        """All live rows."""
        indexed, tail, _ = self._parts()
        indexed = indexed.drop("cell", "code")
        return indexed if tail is None else indexed.unionByName(tail)

    def search(self, query: list[float], k: int, probes: int = 8, refine: int | None = 10, filters: dict | None = None) -> DataFrame:
        """The ``k`` nearest live rows by squared L2 in the ``probes`` nearest cells and among the changes.

        ``refine`` times ``k`` rows are ranked exactly; None trusts the codes. Filters hold before anything is ranked.
        """
        indexed, tail, quantizer = self._parts()
        literal, point = query_literal(query, quantizer.centroids.shape[1]), np.array(query, float)
        gaps = ((quantizer.centroids - point) ** 2).sum(1)
        cells = [int(c) for c in np.lexsort((np.arange(len(gaps)), gaps))[:probes]]
        # A row for each probed cell: probes x stretches x 256 numbers.
        tables = F.broadcast(self.spark.createDataFrame(quantizer.tables(point, cells), "cell int, table array<double>"))
        coded = sum((F.col("table")[F.col("code")[j] + (128 + j * BOOK)] for j in range(1, len(quantizer.books))), F.col("table")[F.col("code")[0] + 128])
        rows = indexed.filter(F.col("cell").isin(cells) & filter_condition(filters)).join(tables, "cell")
        rows = rows.withColumn("distance", coded).drop("table", "code", "cell").orderBy("distance", self.key).limit(k * (refine or 1))
        if refine:
            rows = rows.withColumn("distance", distance(F.col(self.vector), literal))
        if tail is not None:
            fresh = tail.filter(filter_condition(filters)).withColumn("distance", distance(F.col(self.vector), literal))
            rows = rows.unionByName(fresh.orderBy("distance", self.key).limit(k))
        return rows.drop(self.vector).withColumn("score", score(F.col("distance"))).orderBy("distance", self.key).limit(k)

    def plan(
        self, upserts: int = REINDEX_UPSERTS, ratio: float = REINDEX_UNINDEXED_RATIO, unindexed: int = REINDEX_UNINDEXED_ROWS
    ) -> DataFrame:
        """One row: indexed and unindexed rows, ids changed since the build, and whether the index is due."""
        version, _, folded = self.model()
        changed = self._changed(folded)
        counts = self.rows_table.read(version).agg(F.count("*").alias("indexed"))
        if changed is None:
            counts = counts.select("indexed", F.lit(0).cast("long").alias("unindexed"), F.lit(0).cast("long").alias("changed"))
        else:
            now = changed.agg(F.count_if(~F.col("gone")).alias("unindexed"), F.count("*").alias("changed"))
            counts = counts.select("indexed", now.select("unindexed").scalar().alias("unindexed"), now.select("changed").scalar().alias("changed"))
        due = (F.col("changed") >= upserts) | (F.col("unindexed") > F.col("indexed") * ratio) | (F.col("unindexed") > unindexed)
        return counts.withColumn("reindex", due)

    def maintain(self, force: bool = False, grown: float = 2.0, least: int = 64, **thresholds) -> bool:
        """Fold the changes in if the plan says so, and split cells of over ``grown`` times the mean and ``least`` rows.

        Only changed rows and those of split cells are coded anew.
        """
        if not (force or self.plan(**thresholds).first()["reindex"]):
            return False
        folded = max(self.changes.versions(), default=0)
        indexed, tail, quantizer = self._parts()
        live = indexed if tail is None else indexed.unionByName(encoded(tail, quantizer, self.vector))
        sizes = live.groupBy("cell").count().collect()  # one row for each cell
        mean = sum(r["count"] for r in sizes) / max(1, len(quantizer.centroids))
        large = sorted(r["cell"] for r in sizes if r["count"] > max(grown * mean, least))
        if large:
            inside = live.filter(F.col("cell").isin(large))
            share = max(1, TRAIN_ROWS // len(large))
            weights = {r["cell"]: min(1.0, share / r["count"]) for r in sizes}
            keep = F.create_map(*[F.lit(x) for c in large for x in (c, int(weights[c] * 1_000_000))])
            picked = inside.filter(F.pmod(F.xxhash64(self.key), F.lit(1_000_000)) < keep[F.col("cell")])

            def halves(key, part):
                found = trained(_matrix(part[self_vector]), 2)
                return pd.DataFrame({"cell": [key[0]] * len(found), "half": range(len(found)), "v": [c.tolist() for c in found]})

            self_vector = self.vector
            found = picked.select("cell", self.vector).groupBy("cell").applyInPandas(halves, "cell int, half int, v array<double>").collect()
            centroids = [c for c in quantizer.centroids]
            for r in sorted(found, key=lambda r: (r["half"], r["cell"])):
                if r["half"]:
                    centroids.append(np.array(r["v"]))
                else:
                    centroids[r["cell"]] = np.array(r["v"])
            quantizer = Quantizer(np.array(centroids), quantizer.books)
            anew = encoded(inside.drop("cell", "code"), quantizer, self.vector)
            live = live.filter(~F.col("cell").isin(large)).unionByName(anew)
        self._store(live, quantizer, folded)
        return True
