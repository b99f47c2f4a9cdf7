"""Stored vectors and topic models in shared folders, each published by one last small write."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.topics import model_digest
from tessera.sources.tables import saved

VECTORS = "id long, v array<float>, seq long, model string, version int"
FORMAT = 1  # newest layout of a model that this code reads
TABLES = {"centroids": "cluster int, v array<double>", "topics": "cluster int, label string, share double, size long", "means": "key string, mean array<double>", "axes": "axis int, v array<double>"}
PUBLISHED = "version int, folder string, format int, width int, digest string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class VectorStore:
    """Vectors by (model, version, id), for one writer at a time. Writes append a segment; of an id the newest segment counts."""

    def __init__(self, spark: SparkSession, path: str, model: str, version: int):
        self.spark, self.path, self.model, self.version = spark, path, model, version

    def _rows(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], VECTORS)
        return self.spark.read.schema(VECTORS).parquet(self.path).where((F.col("model") == self.model) & (F.col("version") == self.version))

    def vectors(self) -> DataFrame:
        """(id, v) under this model and version; another model or version starts with none."""
        return self._rows().groupBy("id").agg(F.max_by("v", "seq").alias("v"))

    def missing(self, ids: DataFrame) -> DataFrame:
        """The ids (id) that have no vector."""
        return ids.select("id").distinct().join(self._rows().select("id"), "id", "left_anti")

    def upsert(self, rows: DataFrame) -> None:
        """rows (id, v) replace what the store has of their ids. Rows without a vector, or with values that are not finite, are refused."""
        rows = saved(rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")), "new-vectors")
        odd = F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        width = rows.select(F.size("v").alias("w")).unionByName(self._rows().limit(1).select(F.size("v").alias("w"))).distinct().limit(2).count()
        if rows.where(odd | F.col("id").isNull()).limit(1).count() or width > 1:
            raise ValueError("vectors must have an id, finite values and one width")
        seq = (self._rows().agg(F.max("seq")).first()[0] or 0) + 1
        made = rows.dropDuplicates(["id"]).select("id", "v", F.lit(seq).cast("long").alias("seq"), F.lit(self.model).alias("model"), F.lit(self.version).alias("version"))
        made.write.mode("append").partitionBy("model", "version").parquet(self.path)

    def fill(self, rows: DataFrame, embed: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> int:
        """Vectors for the rows (id, text) that have none, by embed over (id, text) batches to (id, v); how many were made."""
        want = saved(rows.join(self.missing(rows), "id", "left_semi").select(F.col("id").cast("long").alias("id"), "text"), "without-vectors")
        n = want.count()
        if n:
            self.upsert(want.mapInPandas(embed, "id long, v array<float>"))
        return n

    def fetch(self, ids: DataFrame) -> DataFrame:
        """ids (id, place) with their vectors, to be read by place; ValueError names ids that have none."""
        if absent := [r[0] for r in self.missing(ids).orderBy("id").limit(5).collect()]:
            raise ValueError(f"no vector for ids {absent}, ...")
        return ids.join(self.vectors(), "id")


class ModelStore:
    """Versions of topic models. A version's tables are written first and the row that publishes it last, so readers see whole models only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _published(self) -> DataFrame:
        at = f"{self.path}/published"
        return self.spark.read.schema(PUBLISHED).parquet(at) if _exists(self.spark, at) else self.spark.createDataFrame([], PUBLISHED)

    def publish(self, model: dict[str, DataFrame], layout: int = FORMAT) -> int:
        """Store a model (TABLES; means and axes may be left out); its version. The same centroids as the active version change nothing.
        ValueError when widths differ, values are not finite, cluster ids repeat or are no 0..k-1, or centroids and topics name other clusters."""
        tables = {n: saved(model[n], f"model-{n}") if n in model else self.spark.createDataFrame([], s) for n, s in TABLES.items()}
        self._check(tables)
        digest = model_digest(tables["centroids"].select("cluster", "v")).first()["digest"]
        active = self._published().orderBy(F.desc("version")).limit(1).collect()
        if active and active[0]["digest"] == digest:
            return active[0]["version"]
        version, folder = (active[0]["version"] if active else 0) + 1, f"model-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.coalesce(1).write.parquet(f"{self.path}/{folder}/{name}")  # a few rows
        width = tables["centroids"].select(F.size("v")).first()[0]
        self.spark.createDataFrame([(version, folder, layout, width, digest)], PUBLISHED).coalesce(1).write.mode("append").parquet(f"{self.path}/published")
        return version

    def load(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, by default the newest. ValueError for a version that is not there or has a layout newer than this code."""
        rows = self._published().where(F.lit(True) if version is None else F.col("version") == version).orderBy(F.desc("version")).limit(1).collect()
        if not rows:
            raise ValueError(f"no model version {version}")
        if rows[0]["format"] > FORMAT:
            raise ValueError(f"model version {rows[0]['version']} has layout {rows[0]['format']}; this code reads up to {FORMAT}")
        tables = {n: self.spark.read.schema(s).parquet(f"{self.path}/{rows[0]['folder']}/{n}") for n, s in TABLES.items()}
        self._check(tables)
        return tables

    def versions(self) -> DataFrame:
        """(version, digest, is_active)"""
        rows = self._published()
        newest = rows.agg(F.max("version").alias("_m"))
        return rows.join(F.broadcast(newest)).select("version", "digest", (F.col("version") == F.col("_m")).alias("is_active"))  # one row

    @staticmethod
    def _check(tables: dict[str, DataFrame]) -> None:
        odd = lambda c: F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        c = tables["centroids"].agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("ids"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.min(F.size("v")).alias("narrow"), F.max(F.size("v")).alias("wide"), F.max(odd("v")).alias("odd")).first()
        if not c["n"] or c["ids"] != c["n"] or c["lo"] != 0 or c["hi"] != c["n"] - 1 or c["narrow"] != c["wide"] or c["narrow"] < 1 or c["odd"]:
            raise ValueError("centroids must be clusters 0..k-1 of one width with finite values")
        known = tables["topics"].groupBy("cluster").count()
        wrong = tables["centroids"].join(known, "cluster", "full_outer").where("v IS NULL OR count IS NULL OR count <> 1")
        if wrong.limit(1).count():
            raise ValueError("every cluster needs one topic row, and no topic another cluster")
        axes = tables["axes"].agg(F.count("*").alias("n"), F.min(F.size("v")).alias("narrow"), F.max(F.size("v")).alias("wide")).first()
        before = axes["wide"] if axes["n"] else c["wide"]  # width of the vectors that means are taken from
        if axes["n"] and (axes["narrow"] != axes["wide"] or axes["n"] < c["wide"]):
            raise ValueError("axes must have one width, and be as many as a centroid has places")
        if tables["means"].where(F.col("mean").isNull() | (F.size("mean") != before)).limit(1).count():
            raise ValueError(f"means must have {before} places")
