"""Vectors of documents as Parquet: points are appended, and the last one of a key counts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import check_dimension

_POINTS = "collection string, key string, embedding array<float>, seq long"


class VectorStore:
    """root/points holds (collection, key, embedding, seq), partitioned by collection. All vectors have the
    dimension the store was made for; one of another length fails its write as a whole."""

    def __init__(self, spark: SparkSession, root: str, dimension: int):
        if dimension < 1:
            raise ValueError("a vector has a dimension of 1 at least")
        self.spark, self.root, self.dimension = spark, root.rstrip("/"), dimension

    def upsert(self, collection: str, rows: DataFrame) -> None:
        """Appends the vectors ``rows`` (key, embedding), in place of those their keys have. Of several of one key
        in ``rows`` any one counts."""
        named = rows.select(F.lit(collection).alias("collection"), F.col("key").cast("string").alias("key"), F.col("embedding").cast("array<float>").alias("embedding"), F.lit(time.time_ns()).alias("seq"))
        check_dimension(named, self.dimension).filter("key is not null").write.mode("append").partitionBy("collection").parquet(f"{self.root}/points")

    def points(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/points")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _POINTS)
        return self.spark.read.schema(_POINTS).parquet(f"{self.root}/points")
