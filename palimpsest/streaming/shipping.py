"""Shipping the log to another place as it grows, pruning what was shipped, and restoring from it."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import Instant, now, parse
from ..operators import retention
from ..schema import LOG, instant
from ..sources.event_log import EventLog


#: JSON keeps milliseconds alone unless told otherwise.
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class Sink(Protocol):
    """Where events and snapshots go."""

    def ship(self, log: EventLog) -> None: ...

    def snapshot(self, log: EventLog) -> str: ...

    def purge(self, before) -> None: ...


class FolderSink:
    """Events as JSON lines, one row an event, and snapshots as Parquet.

    root/events/<n>       shipped events: stream/ as they come, kept/ what a purge left; it makes n + 1
    root/snapshots/snapshot-<seq>-<time>
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _list(self, name: str) -> list[str]:
        fs, path = self._fs(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _turn(self) -> int:
        """The turn of the events: the last one whose purge is complete."""
        done = [int(x.removeprefix("done-")) for x in self._list("events") if x.startswith("done-")]
        return max(done, default=0)

    def ship(self, log: EventLog, available_now: bool = True, interval: str = "30 seconds"):
        """A stream of the log's append folder into JSON; a checkpoint remembers what has been shipped.
        A purge makes a new folder of what is left, with a checkpoint of its own: events of it that
        were shipped before are left out by their sequence numbers."""
        generation = log.generation
        if not log._list(f"{generation}/log"):
            return None
        since = self.last_seq() if int(generation.rpartition("-")[2]) else 0
        marks = self._list(f"since/{generation}")
        if since and not marks:
            fs, path = self._fs(f"since/{generation}/{since}")
            fs.create(path, True).close()
        since = int((marks or [str(since)])[0])
        rows = self.spark.readStream.schema(LOG).parquet(f"{log.root}/{generation}/log").filter(F.col("seq") > F.lit(since))
        stream = rows.writeStream.format("json").options(**_TIMES).option("path", f"{self.root}/events/{self._turn()}/stream").option("checkpointLocation", f"{self.root}/checkpoints/{generation}-{self._turn()}").outputMode("append")
        query = (stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime=interval)).start()
        if available_now:
            query.awaitTermination()
        return query

    def shipped(self) -> DataFrame:
        """The events shipped so far, each once."""
        turn = self._turn()
        # a folder that a stream writes lists its own files alone, so what a purge left is beside it
        there = [x for x in ("kept", "stream") if self._list(f"events/{turn}/{x}")]
        rows = self.spark.createDataFrame([], LOG)
        for x in there:
            rows = rows.unionByName(self.spark.read.options(**_TIMES).schema(LOG).json(f"{self.root}/events/{turn}/{x}"))
        return rows.dropDuplicates(["seq"])

    def last_seq(self) -> int:
        return int(retention.high_water(self.shipped()).first().seq)

    def purge(self, before) -> None:
        """Drops the shipped events of all collections committed before a time."""
        kept = retention.survivors(self.shipped(), before)
        turn = self._turn() + 1
        kept.write.mode("overwrite").options(**_TIMES).json(f"{self.root}/events/{turn}/kept")
        fs, path = self._fs(f"events/done-{turn}")
        fs.create(path, True).close()

    def snapshot(self, log: EventLog, at: Instant | None = None) -> str:
        """A copy of log and stored state as they are; its name has the last sequence number in it and the time,
        to the microsecond, and nothing later than either is in it."""
        rows, base = log.log(), log.base()
        seq = max(int(retention.high_water(rows).first().seq), int(retention.high_water(base).first().seq))
        at = at or now()
        name = f"snapshot-{seq:020d}-{at.at:%Y%m%dT%H%M%S}{at.at.microsecond:06d}Z"
        rows.filter(F.col("seq") <= seq).write.mode("overwrite").partitionBy("collection").parquet(f"{self.root}/snapshots/{name}/log")
        base.write.mode("overwrite").partitionBy("collection").parquet(f"{self.root}/snapshots/{name}/base")
        return name

    def snapshots(self) -> list[tuple[int, str, str]]:
        """(seq, time, name) of all snapshots."""
        found = [x.split("-") for x in self._list("snapshots") if x.startswith("snapshot-")]
        return sorted((int(seq), at, f"snapshot-{seq}-{at}") for _, seq, at in found)

    def restore(self, root: str, target) -> EventLog:
        """A new log at ``root``: the last snapshot from ``target`` or before, and the events shipped
        after it that were committed by then. Sequence numbers and times are kept."""
        at = parse(target)
        fresh = self.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/current")
        if fresh.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fresh):
            raise ValueError(f"there is a log at {root}")
        stamp = f"{at.at:%Y%m%dT%H%M%S}{at.at.microsecond:06d}Z"
        best = max((s for s in self.snapshots() if s[1] <= stamp), default=None)
        events = self.shipped().filter((F.col("tx_time") <= F.lit(at.at).cast("timestamp_ntz")) & (instant("tx_time") <= at.lit()))
        new = EventLog(self.spark, root)
        if best:
            rows, base = (self._stored(f"snapshots/{best[2]}/{x}") for x in ("log", "base"))
            new.append(rows.unionByName(events.filter(F.col("seq") > F.lit(best[0])).select(*LOG.names)))
            new.set_state(base)
        else:
            new.append(events.select(*LOG.names))
        return new

    def _stored(self, name: str) -> DataFrame:
        there = any(x.startswith("collection=") for x in self._list(name))
        rows = self.spark.read.schema(LOG).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], LOG)
        return rows.select(*LOG.names)
