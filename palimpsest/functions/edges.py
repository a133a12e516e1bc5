"""Identity and routing of edges of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EDGES

OUT, IN, BOTH = "out", "in", "both"


def _measured(c: Column) -> Column:
    """The bytes of a string after their number, as four bytes, most significant first."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0")), c.cast("binary"))


def edge_key(source: Column, kind: Column, target: Column) -> Column:
    """The key of an edge: the same for the same triple, whatever the parts contain."""
    return F.sha2(F.concat(_measured(source), _measured(kind), _measured(target)), 256)


def edge_meta(source: Column, kind: Column, target: Column) -> Column:
    return F.to_json(F.struct(source.alias("from"), kind.alias("type"), target.alias("to")))


def touches(node: str, direction: str) -> Column:
    """Edges that leave the node, enter it, or either."""
    direction = direction.lower()
    if direction not in (OUT, IN, BOTH):
        raise ValueError(f"unknown direction {direction!r}")
    leaves, enters = F.col("from") == F.lit(node), F.col("to") == F.lit(node)
    return leaves if direction == OUT else enters if direction == IN else leaves | enters


def with_routing(rows: DataFrame) -> DataFrame:
    """``rows`` of a log with the columns from, type and to of edges, null for documents: as they are, if they
    have them, or from ``meta``."""
    if {"from", "type", "to"} <= set(rows.columns):
        return rows
    meta = F.when(F.col("collection") == EDGES, F.from_json("meta", "from string, type string, to string"))
    return rows.withColumn("__m", meta).withColumns({n: F.col(f"__m.{n}") for n in ("from", "type", "to")}).drop("__m")
