"""One object for all verbs, over an event log, its graph, vectors and backups."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from .operators import documents, graph, search, versions
from .schema import ROW
from .sources.event_log import STATE_EVERY, EventLog
from .sources.vectors import VectorStore


#: Rows that ``run`` hands over as plain values.
PAGE = 10_000


@dataclass
class Settings:
    ship_interval: timedelta = timedelta(seconds=30)
    snapshot_interval: timedelta = timedelta(hours=1)
    retention: timedelta | None = None
    state_every: int = STATE_EVERY
    searcher: search.Searcher | None = None
    #: Numbers in a vector; none where there is no vector search.
    dimension: int | None = None
    reranker: Callable[[DataFrame], DataFrame] | None = None


class Database:
    """Reads give lazy DataFrames; writes give nothing and are on disk when they return. A past state is read
    with ``as_of``. ``events.keep_state()`` writes current state anew when enough has come since."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, points: DataFrame | None = None, sink=None):
        self.settings = settings or Settings()
        self.spark, self.events = spark, EventLog(spark, root, self.settings.state_every)
        self.points, self.sink = points, sink
        self.vectors = VectorStore(spark, f"{root.rstrip('/')}/vectors", self.settings.dimension) if self.settings.dimension else None

    def get(self, collection: str, key, as_of=None) -> DataFrame:
        log, base = self._needed(as_of)
        return documents.get(log, collection, key, as_of, base)

    def find(self, collection: str, where: Iterable = (), as_of=None, order_by: str | None = None, desc: bool = False, limit: int | None = None, offset: int | None = None) -> DataFrame:
        log, base = self._needed(as_of)
        return documents.find(log, collection, where, as_of, order_by, desc, limit, offset, base)

    def _needed(self, as_of=None) -> tuple[DataFrame, DataFrame]:
        """The events and the stored state a read needs: no history for current state."""
        return self.events.recent() if as_of is None else self.events.log(), self.events.base()

    def put(self, collection: str, key, document: dict | str, at=None) -> None:
        self.events.put(collection, key, document, at)

    def delete(self, collection: str, key) -> None:
        self.events.delete(collection, key)

    def history(self, collection: str, key, between: tuple | None = None) -> DataFrame:
        return versions.history(self.events.log(), collection, key, between).select(*ROW)

    def relate(self, source: str, kind: str, target: str, props: dict | None = None) -> None:
        self.events.relate(source, kind, target, props)

    def unrelate(self, source: str, kind: str, target: str) -> None:
        self.events.unrelate(source, kind, target)

    def related(self, node: str, types=(), direction: str = "both", as_of=None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        log, base = self._needed(as_of)
        return graph.related(log, node, types, direction, as_of, limit, offset, base)

    def edge_types(self) -> DataFrame:
        return graph.edge_types(*self._needed())

    def index(self, collection: str, rows: DataFrame, text: str = "text") -> None:
        """Gives the documents ``rows`` (key, and a column of text) vectors, all in batches on the executors."""
        if self.settings.searcher is None or self.vectors is None:
            raise ValueError("vector search is not configured")
        self.vectors.upsert(collection, search.embed_column(rows, self.settings.searcher, text))

    def search(self, collection: str, near: str, where: Iterable = (), limit: int | None = None, offset: int | None = None) -> DataFrame:
        query = search.embed(self.settings.searcher, near)
        points = self.points if self.points is not None else self.vectors.points() if self.vectors else None
        if points is None:
            raise ValueError("SEARCH needs vector search, which is not configured")
        log, base = self._needed()
        return search.search(log, search.latest_points(points), collection, query, where, limit, offset, base, self.settings.reranker)

    def purge(self, collection: str, before) -> int:
        """Drops history from before a time; shipped events of all collections from before it go too."""
        n = self.events.purge(collection, before)
        if self.sink is not None:
            self.sink.purge(before)
        return n

    def retain(self, age: timedelta | None = None) -> dict[str, int]:
        """Purges what is older than ``age`` from every collection."""
        age = age or self.settings.retention
        if not age:
            return {}
        cutoff = datetime.now(UTC) - age
        gone = self.events.sweep(cutoff)
        if self.sink is not None:
            self.sink.purge(cutoff)
        return gone

    def run(self, calls: Iterable[tuple]) -> dict:
        """Runs (verb, arguments...) in order up to the first that fails: results so far, and the error."""
        results: list = []
        error = None
        for verb, *args in calls:
            try:
                keywords = args.pop() if args and isinstance(args[-1], dict) and verb not in ("put", "relate") else {}
                if verb not in VERBS:
                    raise ValueError(f"unknown verb {verb!r}")
                found = getattr(self, verb)(*args, **keywords)
                results.append(self.result(verb, found))
            except Exception as e:  # the caller gets it with what ran before
                error = str(e)
                break
        return {"results": results, "error": error}

    @staticmethod
    def result(verb: str, found) -> dict:
        """What a call gave, as plain values; a result of more than PAGE rows is an error, to be read as a DataFrame."""
        if verb == "purge":
            return {"purged": found}
        if not isinstance(found, DataFrame):
            return {}
        rows = [r.asDict() for r in found.limit(PAGE + 1).collect()]
        if len(rows) > PAGE:
            raise ValueError(f"more than {PAGE} rows: give a limit, or read the DataFrame")
        if verb == "edge_types":
            return {"edge_types": [r["type"] for r in rows]}
        for r in rows:
            for c in ("value", "props"):
                if r.get(c) is not None:
                    r[c] = json.loads(r[c])
        name = "edges" if verb == "related" else "rows"
        return {name: rows} if rows else {}


VERBS = ("get", "find", "put", "delete", "history", "relate", "unrelate", "related", "edge_types", "search", "purge")
