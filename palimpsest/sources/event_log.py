"""The event log as Parquet folders: append-only batches, a stored current state, and a rewrite at a purge.

    root/current/<n>              an empty file: generation n is complete; the highest one counts
    root/gen-<n>/log              events, partitioned by collection
    root/gen-<n>/state/<seq>      the last version of each key up to <seq>, tombstones included

Current state is read from the newest state and the events after it, so it doesn't replay history; the state
also keeps last versions that outlive purged history. A purge writes the next generation and then marks it,
so readers of the old one go on, and a purge or writer that fails changes nothing. Sequence numbers and
commit times are given by the one writer. A write is on disk when its call returns; in a ``batch`` it is when
the batch ends, all of it at once.

Stored rows carry the routing of edges in columns of their own, so that reads of a node's edges can be pushed
down to the scan.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import valid_document
from ..functions.edges import edge_key, edge_meta, with_routing
from ..functions.instants import ZERO, Instant, now, parse
from ..operators import retention, versions
from ..schema import DELETE, EDGES, LOG, PUT, STORED


#: Events after which the current state is written anew, unless told otherwise.
STATE_EVERY = 100_000
#: What the scan may look up in a row group before it reads it.
_BLOOMS = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("key", "from", "to")}


class EventLog:
    def __init__(self, spark: SparkSession, root: str, state_every: int = STATE_EVERY):
        self.spark, self.root, self.state_every = spark, root.rstrip("/"), state_every
        self._lock = threading.RLock()
        self._held: list[tuple] = []
        self._batches = 0
        self._seq: int | None = None
        self._last: Instant | None = None
        if not self._list("current"):
            self._mark("current/0")

    # files

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _list(self, name: str) -> list[str]:
        fs, path = self._fs(name)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _mark(self, name: str) -> None:
        fs, path = self._fs(name)
        fs.create(path, True).close()

    @property
    def generation(self) -> str:
        return f"gen-{max(int(x) for x in self._list('current') if x.isdigit())}"

    def _frame(self, name: str | None) -> DataFrame:
        if not name or not any(x.startswith("collection=") for x in self._list(name)):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(f"{self.root}/{name}").select(*STORED.names)

    def _write(self, rows: DataFrame, name: str, *order: str, mode: str = "errorifexists") -> None:
        rows.sortWithinPartitions("collection", *order).write.mode(mode).options(**_BLOOMS).partitionBy("collection").parquet(f"{self.root}/{name}")

    def _state(self) -> tuple[int, str | None]:
        """(seq, folder) of the newest state that is complete."""
        folder = f"{self.generation}/state"
        done = [int(x) for x in self._list(folder) if x.isdigit() and "_SUCCESS" in self._list(f"{folder}/{x}")]
        return (max(done), f"{folder}/{max(done)}") if done else (0, None)

    # reading

    def log(self) -> DataFrame:
        """All events that are kept."""
        return self._frame(f"{self.generation}/log")

    def base(self) -> DataFrame:
        """The stored state: last versions, tombstones included."""
        return self._frame(self._state()[1])

    def recent(self) -> DataFrame:
        """The events after the stored state: with ``base``, all that current state needs."""
        return self.log().filter(F.col("seq") > F.lit(self._state()[0]))

    def live(self) -> DataFrame:
        return versions.live(self.recent(), self.base())

    def last_seq(self) -> int:
        with self._lock:
            if self._seq is None:
                both = self.log().unionByName(self.base())
                row = both.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s"), F.max(F.struct("tx_time", "tx_time_ns")).alias("t")).first()
                self._seq = int(row.s)
                self._last = Instant(row.t[0], row.t[1] or 0) if row.t and row.t[0] else None
            return self._seq

    # writing

    @contextmanager
    def batch(self) -> Iterator[None]:
        """Writes inside are committed together when it ends, none of them if it fails."""
        with self._lock:
            self.last_seq()
            before = (len(self._held), self._seq, self._last)
            self._batches += 1
            try:
                yield
            except BaseException:
                del self._held[before[0] :]
                _, self._seq, self._last = before
                raise
            finally:
                self._batches -= 1
            self._commit()

    def _add(self, collection: str, key: str, op: str, value: str | None, meta: str, at) -> int:
        if not collection or not key:
            raise ValueError("a collection and a key are needed")
        with self._lock:
            seq = self.last_seq() + 1
            tx = now(self._last)
            valid = parse(at) if at is not None else ZERO
            valid = tx if valid.is_zero else valid
            before = self._seq, self._last
            self._held.append((seq, collection, key, op, value, meta, valid.at, valid.ns, tx.at, tx.ns))
            self._seq, self._last = seq, tx
            try:
                self._commit()
            except BaseException:
                self._seq, self._last = before
                raise
            return seq

    def put(self, collection: str, key: Any, document: dict | str, at=None) -> int:
        """Appends a version; valid from now on, or from ``at``. Returns its sequence number."""
        text = document if isinstance(document, str) else json.dumps(document, ensure_ascii=False, allow_nan=False)
        if not isinstance(_load(text), dict):
            raise ValueError("a document is a JSON object")
        return self._add(collection, str(key), PUT, text, "{}", at)

    def delete(self, collection: str, key: Any) -> int:
        """Appends a tombstone, whether or not there is a document."""
        return self._add(collection, str(key), DELETE, None, "{}", None)

    def relate(self, source: str, kind: str, target: str, props: dict | str | None = None) -> int:
        text = props if isinstance(props, str) else json.dumps(props or {}, ensure_ascii=False, allow_nan=False)
        if not isinstance(_load(text), dict):
            raise ValueError("properties are a JSON object")
        return self._edge(source, kind, target, PUT, text)

    def unrelate(self, source: str, kind: str, target: str) -> int:
        """Appends a tombstone, with the routing of the edge, so reads may filter on it early."""
        return self._edge(source, kind, target, DELETE, None)

    def _edge(self, source: str, kind: str, target: str, op: str, value: str | None) -> int:
        if not (source and kind and target):
            raise ValueError("an edge has a source, a type and a target")
        key, meta = self._edge_parts(source, kind, target)
        return self._add(EDGES, key, op, value, meta, None)

    @staticmethod
    def _edge_parts(source: str, kind: str, target: str) -> tuple[str, str]:
        import hashlib

        parts = [p.encode() for p in (source, kind, target)]
        key = hashlib.sha256(b"".join(len(p).to_bytes(4, "big") + p for p in parts)).hexdigest()
        return key, json.dumps({"from": source, "type": kind, "to": target}, ensure_ascii=False)

    def _commit(self) -> None:
        if self._held and not self._batches:
            rows, self._held = self._held, []
            self.append(self.spark.createDataFrame(rows, LOG).coalesce(1))

    def append(self, events: DataFrame) -> None:
        """Appends events as they are, sequence numbers and times included (restores, bulk loads)."""
        with self._lock:
            rows = with_routing(events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG]))
            self._write(rows, f"{self.generation}/log", "from", "key", "seq", mode="append")

    def keep_state(self, force: bool = False) -> bool:
        """Writes the current state anew if ``state_every`` events came since. Readers take the newest one
        that is complete; older ones are left to readers that have begun."""
        with self._lock:
            enough = 1 if force else self.state_every  # bulk loads leave gaps between numbers, so rows are counted
            if self.recent().limit(enough).count() < enough:
                return False
            rows = versions.latest(self.recent(), self.base())
            self._write(rows, f"{self.generation}/state/{self.last_seq()}", "from", "key", mode="overwrite")
            return True

    def set_state(self, base: DataFrame) -> None:
        """Takes ``base`` for the state up to its last event (restores); nothing if it is empty."""
        with self._lock:
            seq = int(retention.high_water(base).first().seq)
            if seq:
                self._write(with_routing(base.select(*LOG.names)), f"{self.generation}/state/{seq}", "from", "key", mode="overwrite")
                self._seq = None

    def load(self, rows: DataFrame) -> None:
        """Appends many documents at once: collection, key, value, and valid_from if there is one.
        Sequence numbers rise but leave gaps; all rows share the commit time. A value that ``put`` would
        reject fails the load, and nothing of it is kept."""
        value = F.when(valid_document(F.col("value")), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a document: "), F.coalesce(F.substring("value", 1, 100), F.lit("null")))))
        with self._lock:
            first, tx = self.last_seq() + 1, now(self._last)
            self._bulk(rows, first, tx, F.col("collection"), F.col("key").cast("string"), value, F.lit("{}"))

    def load_edges(self, rows: DataFrame) -> None:
        """Appends many edges at once: from, type, to, props, and valid_from if there is one."""
        parts = F.col("from"), F.col("type"), F.col("to")
        with self._lock:
            first, tx = self.last_seq() + 1, now(self._last)
            self._bulk(rows, first, tx, F.lit(EDGES), edge_key(*parts), F.col("props"), edge_meta(*parts))

    def _bulk(self, rows: DataFrame, first: int, tx: Instant, collection: Column, key: Column, value: Column, meta: Column) -> None:
        given = F.col("valid_from").cast("timestamp_ntz") if "valid_from" in rows.columns else F.lit(None).cast("timestamp_ntz")
        commit = F.lit(tx.at).cast("timestamp_ntz")
        # without a time of its own a row is valid from its commit on, to the nanosecond
        times = F.coalesce(given, commit).alias("valid_from"), F.when(given.isNull(), tx.ns).otherwise(0).alias("valid_from_ns"), commit.alias("tx_time"), F.lit(tx.ns).alias("tx_time_ns")
        self._seq = None  # known again when it is asked for
        self.append(rows.select((F.lit(first) + F.monotonically_increasing_id()).alias("seq"), collection.alias("collection"), key.alias("key"), F.lit(PUT).alias("op"), value.alias("value"), meta.alias("meta"), *times))

    def purge(self, collection: str, before) -> int:
        """Drops a collection's events committed before a time, its newest included; current state stays.
        Returns how many."""
        return self.sweep(before, [collection]).get(collection, 0)

    def sweep(self, before, collections: Iterable[str] | None = None) -> dict[str, int]:
        """As ``purge`` for several collections, or all, in one rewrite; nothing is rewritten where nothing
        goes. Returns how many events of each were dropped."""
        with self._lock:
            log, some = self.log(), None if collections is None else list(collections)
            counts = log.groupBy("collection").agg(F.count(F.when(retention.before(before), 1)).alias("n"))
            gone = {r.collection: int(r.n) for r in counts.collect() if some is None or r.collection in some}
            if not any(gone.values()):
                return gone
            new = f"gen-{int(self.generation.rpartition('-')[2]) + 1}"
            self._write(versions.latest(self.recent(), self.base()), f"{new}/state/{self.last_seq()}", "from", "key", mode="overwrite")
            kept = log.filter(~(retention.before(before) & F.col("collection").isin(list(gone))))
            self._write(kept, f"{new}/log", "from", "key", "seq", mode="overwrite")
            self._mark(f"current/{new.removeprefix('gen-')}")
            return gone


def _load(text: str) -> Any:
    """JSON without repeated keys, NaN or infinities."""

    def once(pairs: Iterable[tuple[str, Any]]) -> dict:
        found: dict = {}
        for k, v in pairs:
            if k in found:
                raise ValueError(f"repeated key {k!r}")
            found[k] = v
        return found

    def no(x: str):
        raise ValueError(f"{x} is not JSON")

    return json.loads(text, object_pairs_hook=once, parse_constant=no)
