"""Search by similarity of vectors, then by conditions on the current documents found."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import documents as D
from ..schema import ROW
from . import versions

DEFAULT_LIMIT = 10


class Searcher(Protocol):
    """Turns texts into vectors."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def embed(searcher: Searcher | None, text: str) -> list[float]:
    if searcher is None:
        raise ValueError("SEARCH needs vector search, which is not configured")
    found = searcher([text])
    if len(found) != 1:
        raise ValueError(f"asked for 1 vector, got {len(found)}")
    return [float(x) for x in found[0]]


def embed_column(df: DataFrame, searcher: Callable, text: str, out: str = "embedding") -> DataFrame:
    """``df`` with the vector of ``text``, in batches; nothing is asked for an empty batch."""

    @F.pandas_udf("array<float>")
    def vectors(texts):
        import pandas as pd

        if not len(texts):
            return pd.Series([], dtype=object)
        found = searcher(texts.fillna("").tolist())
        if len(found) != len(texts):
            raise ValueError(f"asked for {len(texts)} vectors, got {len(found)}")
        return pd.Series([list(map(float, v)) for v in found], dtype=object)

    return df.withColumn(out, vectors(F.col(text)))


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity in double precision; null for a vector of other length or of no length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    both = norm(v) * norm(q)
    return F.when((F.size(vector) == len(query)) & (both > 0), dot / both)


def latest_points(points: DataFrame) -> DataFrame:
    """The last vector of each key of an append-only (collection, key, embedding, seq)."""
    return points.groupBy("collection", "key").agg(F.max_by("embedding", "seq").alias("embedding"))


def check_dimension(points: DataFrame, size: int) -> DataFrame:
    """``points``; reading it fails at a vector of another length."""
    ok = F.coalesce(F.size("embedding") == size, F.lit(False))
    return points.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector doesn't have {size} dimensions"))))


def top_k(points: DataFrame, collection: str, query: Sequence[float], k: int) -> DataFrame:
    """(collection, key, score, rank) of the ``k`` most similar points with a key; ties by key."""
    scored = points.filter((F.col("collection") == collection) & F.col("key").isNotNull()).select("collection", "key", cosine(F.col("embedding"), query).alias("score")).filter("score is not null")
    best = scored.orderBy(F.desc("score"), "key").limit(k)
    # k rows, ranked in one small task
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("score"), "key")))


def search(log: DataFrame, points: DataFrame, collection: str, query: Sequence[float], where: Iterable = (), limit: int | None = None, offset: int | None = None, base: DataFrame | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Current documents of the most similar points, most similar first. Conditions are applied to the
    page of points found, so fewer rows than the limit may come back; points whose document is gone
    drop out. ``rerank`` may replace the (collection, key, score, rank) of the points."""
    limit, offset = limit or 0, offset or 0
    k = limit + offset if limit > 0 else DEFAULT_LIMIT
    best = top_k(points, collection, query, k)
    if rerank:
        best = rerank(best)
    best = best.filter(F.col("rank") > F.lit(offset))
    one = lambda df: df.filter(F.col("collection") == collection).join(F.broadcast(best.select("key")), "key", "left_semi").select("seq", "op", *ROW)
    rows = versions.live(one(log), None if base is None else one(base)).filter(D.matches(F.col("value"), where, D.LIVE))
    # at most k rows are broadcast
    return rows.join(F.broadcast(best.select("key", "score", "rank")), "key").orderBy("rank").select(*ROW, "score", "rank")
