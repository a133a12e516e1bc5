"""Which version of each document counts: the picks that all reads are made of.

A pick comes first; tombstones are dropped and conditions on values applied to what it gives. What
may run below a pick are conditions on collection, key and time. Picks are aggregates per key, so
they combine before the shuffle: a key that holds a third of all events is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import Instant, parse
from ..schema import DELETE, PUT, instant


def _upto(log: DataFrame, name: str, at: Instant) -> DataFrame:
    # the plain comparison lets the scan skip row groups; the other one settles the nanoseconds
    return log.filter((F.col(name) <= F.lit(at.at).cast("timestamp_ntz")) & (instant(name) <= at.lit()))


def _pick(log: DataFrame, by) -> DataFrame:
    rest = [c for c in log.columns if c not in ("collection", "key")]
    best = log.groupBy("collection", "key").agg(F.max_by(F.struct(*rest), by).alias("pick"))
    return best.select(*[F.col(c) if c in ("collection", "key") else F.col(f"pick.{c}").alias(c) for c in log.columns])


def latest(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The last committed version of each key, tombstones included: highest seq, whatever its valid time.
    ``base`` holds last versions that outlive their history."""
    rows = log if base is None else base.unionByName(log)
    return _pick(rows, F.col("seq"))


def live(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Current state: last committed versions that aren't tombstones."""
    return latest(log, base).filter(F.col("op") == PUT)


def visible(log: DataFrame, valid_at=None, as_of=None, tombstones: bool = False) -> DataFrame:
    """The version of each key valid at ``valid_at`` as known at ``as_of``: of the versions committed
    by then and valid from then or before, the one with the latest valid time; of ties the last
    committed. ``valid_at`` defaults to ``as_of``, none at all to the latest valid time."""
    known = parse(as_of) if as_of is not None else None
    at = parse(valid_at) if valid_at is not None else known
    rows = log
    if known is not None and not known.is_zero:
        rows = _upto(rows, "tx_time", known)
    if at is not None and not at.is_zero:
        rows = _upto(rows, "valid_from", at)
    found = _pick(rows, F.struct(instant("valid_from"), F.col("seq")))
    return found if tombstones else found.filter(F.col("op") == PUT)


def history(log: DataFrame, collection: str, key: str, between: tuple | None = None) -> DataFrame:
    """All versions of a key in order of commit, tombstones without value; ``between`` bounds valid
    times at both ends, ends included."""
    rows = log.filter((F.col("collection") == collection) & (F.col("key") == str(key)))
    if between:
        low, high = map(parse, between)
        rows = _upto(rows, "valid_from", high).filter((F.col("valid_from") >= F.lit(low.at).cast("timestamp_ntz")) & (instant("valid_from") >= low.lit()))
    return rows.withColumn("value", F.when(F.col("op") == PUT, F.col("value"))).orderBy("seq")


def intervals(log: DataFrame) -> DataFrame:
    """Adds ``valid_to``, ``valid_to_ns``: where the validity of a version ends (null: open).

    A key's versions are spread over days of valid time, and the last one of a day ends where the next day
    with versions begins, so no task holds all versions of a hot key."""
    day = F.col("valid_from").cast("date")
    begin = F.struct("valid_from", "valid_from_ns")
    first = log.groupBy("collection", "key", day.alias("day")).agg(F.min(begin).alias("begin"))
    days = first.withColumn("after_day", F.lead("begin").over(Window.partitionBy("collection", "key").orderBy("day"))).drop("begin")
    w = Window.partitionBy("collection", "key", "day").orderBy("valid_from", "valid_from_ns", "seq")
    # the window's partitioning serves the join as well
    found = log.withColumn("day", day).withColumn("in_day", F.lead(begin).over(w)).join(days, ["collection", "key", "day"], "left")
    end = F.coalesce("in_day", "after_day")
    return found.select(*log.columns, end["valid_from"].alias("valid_to"), end["valid_from_ns"].alias("valid_to_ns"))


def after(log: DataFrame, seq: int) -> DataFrame:
    """Events of all collections after ``seq``, in order."""
    return log.filter(F.col("seq") > F.lit(seq)).orderBy("seq")


def valid_when(log: DataFrame, asked: DataFrame) -> DataFrame:
    """For each row of ``asked`` (collection, key, at) the version valid at ``at``, null where none is.

    A point-in-time lookup for many rows at once: both sides go through one sort per key. A key's rows
    are spread over days of valid time; each day starts from the last version before it, so no task
    holds all events of a hot key."""
    # what each version and question is, in one order: versions before questions of the same time
    versions = log.select("collection", "key", F.col("valid_from").cast("date").alias("day"), F.col("valid_from").alias("at"), F.coalesce("valid_from_ns", F.lit(0)).cast("int").alias("ns"), "seq", F.lit(0).alias("kind"), F.struct("seq", "op", "value", "valid_from", "tx_time").alias("version"), F.lit(None).cast("long").alias("row"))
    numbered = asked.withColumn("row", F.monotonically_increasing_id())
    questions = numbered.select("collection", "key", F.col("at").cast("date").alias("day"), "at", F.lit(999).alias("ns"), F.lit(None).cast("long").alias("seq"), F.lit(1).alias("kind"), F.lit(None).cast(versions.schema["version"].dataType).alias("version"), "row")
    # the last version of each day, carried to the days of the key that follow
    last = versions.groupBy("collection", "key", "day").agg(F.max_by("version", F.struct("at", "ns", "seq")).alias("version"))
    days = last.select("collection", "key", "day", "version").unionByName(questions.select("collection", "key", "day").distinct(), allowMissingColumns=True)
    days = days.groupBy("collection", "key", "day").agg(F.max("version").alias("version"))
    w = Window.partitionBy("collection", "key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("version", F.last("version", ignorenulls=True).over(w)).filter("version is not null")
    start = carried.select("collection", "key", "day", F.lit("0001-01-01").cast("timestamp_ntz").alias("at"), F.lit(0).alias("ns"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("kind"), "version", F.lit(None).cast("long").alias("row"))
    w = Window.partitionBy("collection", "key", "day").orderBy("at", "ns", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    found = versions.unionByName(questions).unionByName(start).withColumn("version", F.last("version", ignorenulls=True).over(w)).filter("row is not null")
    there = F.col("version.op") != DELETE
    return found.select("collection", "key", "at", *[F.when(there, F.col(f"version.{c}")).alias(c) for c in ("value", "valid_from", "seq")])
