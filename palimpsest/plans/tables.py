"""Tables of the test data in the shapes of the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.edges import edge_key, edge_meta
from ..schema import DELETE, EDGES, LOG, PUT, STORED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for a log, its shipped events and what is restored from them."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='palimpsest-')).rstrip('/')}/store-{uuid.uuid4().hex}"


def _log(rows: DataFrame) -> DataFrame:
    kinds = STORED if "from" in rows.columns else LOG
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])


def _versions(rows: DataFrame, *events: Column) -> DataFrame:
    """Each row's events, each a struct (seq, op, value, at); null ones are left out."""
    each = F.explode(F.filter(F.array(*events), lambda e: e.isNotNull()))
    return rows.withColumn("__e", each).select(*rows.columns, *[F.col(f"__e.{n}").alias(n) for n in ("seq", "op", "value", "at")])


def _event(seq: Column, op: str, value: Column | None, at: Column) -> Column:
    text = F.lit(None).cast("string") if value is None else value
    return F.struct(seq.cast("long").alias("seq"), F.lit(op).alias("op"), text.alias("value"), at.cast("timestamp_ntz").alias("at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log: valid times run up to six days behind commits, so the two orders differ."""
    e = table(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    return _log(e.select(F.col("event_id").alias("seq"), F.lit("users").alias("collection"), F.col("user_id").cast("string").alias("key"), F.when(gone, "delete").otherwise(PUT).alias("op"), F.when(~gone, F.col("props")).alias("value"), F.lit("{}").alias("meta"), F.expr("ts - make_dt_interval(cast(event_id % 7 as int))").alias("valid_from"), F.lit(0).alias("valid_from_ns"), F.col("ts").alias("tx_time"), F.lit(0).alias("tx_time_ns")))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with their labels as a log of JSON documents; fields without a value are left out. Each has an
    outdated first version, and every tenth is deleted after its second one."""
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.select("doc_id", "lang", "source", "n_chars").join(marks, "doc_id", "left")
    value = F.to_json(F.struct("lang", "n_chars", "quality", F.array("lang", "source").alias("tags"), F.struct("source").alias("origin"), (F.col("n_chars") > 1000).alias("long")))
    old = F.lit('{"lang":"fr","n_chars":501,"quality":0,"tags":["fr","src7"],"origin":{"source":"src2"},"long":true}')
    first = F.col("doc_id") * 4
    at = [F.lit(x) for x in ("2023-01-01", "2024-01-01", "2024-01-02")]
    rows = _versions(rows.withColumn("new", value), _event(first, PUT, old, at[0]), _event(first + 1, PUT, F.col("new"), at[1]), F.when(F.col("doc_id") % 10 == 0, _event(first + 2, DELETE, None, at[2])))
    return _log(rows.select("seq", F.lit("docs").alias("collection"), F.col("doc_id").cast("string").alias("key"), "op", "value", F.lit("{}").alias("meta"), F.col("at").alias("valid_from"), F.lit(0).alias("valid_from_ns"), F.col("at").alias("tx_time"), F.lit(0).alias("tx_time_ns")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as edges from customers, of a type by their state, with their routing in columns. Each has an
    outdated first version; those of type cancelled, every seventh, are gone ten days after the order."""
    o = table(spark, sf_dir, "orders")
    gone = F.col("o_orderkey") % 7 == 0
    kind = F.when(gone, "cancelled").when(F.col("o_orderstatus") == "F", "fulfilled").otherwise("placed")
    ends = F.concat(F.lit("customer/"), F.col("o_custkey")), kind, F.concat(F.lit("orders/"), F.col("o_orderkey"))
    props = F.concat(F.lit('{"priority":"'), F.col("o_orderpriority"), F.lit('"}'))
    first, at = F.col("o_orderkey") * 3, F.col("o_orderdate")
    rows = o.select(*[c.alias(n) for c, n in zip(ends, ("from", "type", "to"), strict=True)], props.alias("props"), first.alias("first"), at.alias("day"), gone.alias("gone"))
    day = F.col("day")
    rows = _versions(rows, _event(F.col("first"), PUT, F.lit('{"priority":"old"}'), F.expr("day - interval 30 days")), _event(F.col("first") + 1, PUT, F.col("props"), day), F.when(F.col("gone"), _event(F.col("first") + 2, DELETE, None, F.expr("day + interval 10 days"))))
    parts = F.col("from"), F.col("type"), F.col("to")
    return _log(rows.select("seq", F.lit(EDGES).alias("collection"), edge_key(*parts).alias("key"), "op", "value", edge_meta(*parts).alias("meta"), F.col("at").alias("valid_from"), F.lit(0).alias("valid_from_ns"), F.col("at").alias("tx_time"), F.lit(0).alias("tx_time_ns"), "from", "type", "to"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as points of a collection."""
    return table(spark, sf_dir, "embeddings").select(F.lit("docs").alias("collection"), F.col("vec_id").cast("string").alias("key"), "embedding", F.col("vec_id").alias("seq"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    """One vector, to ask with."""
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding]
