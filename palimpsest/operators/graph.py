"""The versioned graph: edges are events of a collection of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edges import BOTH, touches, with_routing
from ..schema import EDGE, EDGES
from . import versions
from .documents import page


def as_edges(rows: DataFrame) -> DataFrame:
    """Versions of edges with their routing; rows without a type are no edges."""
    found = with_routing(rows).filter(F.col("type").isNotNull())
    return found.select("from", "type", "to", F.coalesce("value", F.lit("{}")).alias("props"), *[c for c in found.columns if c in EDGE and c not in ("from", "type", "to") or c == "key"])


def edges(log: DataFrame, as_of=None, base: DataFrame | None = None) -> DataFrame:
    """Current edges or, ``as_of`` a time, those valid then."""
    one = lambda df: with_routing(df.filter(F.col("collection") == EDGES))
    return as_edges(versions.live(one(log), None if base is None else one(base)) if as_of is None else versions.visible(one(log), valid_at=as_of))


def related(log: DataFrame, node: str, types: Sequence[str] = (), direction: str = BOTH, as_of=None, limit: int | None = None, offset: int | None = None, base: DataFrame | None = None) -> DataFrame:
    """Edges that touch a node: the current ones in order of commit, those of a past time in order of key.

    The routing of an edge is part of its key, and tombstones keep it, so the filter on node and type
    runs below the pick: no version it drops could have won."""
    wanted = touches(node, direction)
    if types:
        wanted = wanted & F.col("type").isin(*types)

    one = lambda df: with_routing(df.filter(F.col("collection") == EDGES)).filter(wanted).drop("meta")
    picked = versions.live(one(log), None if base is None else one(base)) if as_of is None else versions.visible(one(log), valid_at=as_of)
    found = as_edges(picked).orderBy("seq" if as_of is None else "key")
    return page(found.select(*EDGE), limit, offset)


def edge_types(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The types current edges have, in order."""
    one = lambda df: with_routing(df.filter(F.col("collection") == EDGES)).select("collection", "key", "seq", "op", "type")
    current = versions.live(one(log), None if base is None else one(base))
    return current.filter(F.col("type").isNotNull()).select("type").distinct().orderBy("type")
