"""What a purge takes and leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import parse
from ..schema import instant


def before(cutoff) -> Column:
    """Events committed before the cutoff, itself excluded."""
    at = parse(cutoff)
    return (F.col("tx_time") <= F.lit(at.at).cast("timestamp_ntz")) & (instant("tx_time") < at.lit())


def survivors(log: DataFrame, cutoff, collection: str | None = None) -> DataFrame:
    """The log without a collection's (or all) events from before the cutoff."""
    gone = before(cutoff)
    return log.filter(~(gone & (F.col("collection") == collection) if collection is not None else gone))


def purged(log: DataFrame, collection: str, cutoff) -> DataFrame:
    """One row: how many events a purge takes."""
    return log.filter(F.col("collection") == collection).agg(F.count(F.when(before(cutoff), 1)).alias("purged"))


def collections(log: DataFrame) -> DataFrame:
    return log.select("collection").distinct()


def high_water(log: DataFrame) -> DataFrame:
    """One row: the highest seq, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("seq"))
