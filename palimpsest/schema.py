"""Schemas of the event log and of what is derived from it.

An instant is a timestamp in microseconds and the nanoseconds left over (0 to 999), compared in that
order. ``value`` keeps the document's text as it was written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = "__edges__"
PUT, DELETE = "put", "delete"


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


LOG = _schema(
    ("seq", T.LongType(), True),
    ("collection", T.StringType(), True),
    ("key", T.StringType(), True),
    ("op", T.StringType(), True),
    ("value", T.StringType(), True),
    ("meta", T.StringType(), True),
    ("valid_from", T.TimestampNTZType(), True),
    ("valid_from_ns", T.ShortType(), True),
    ("tx_time", T.TimestampNTZType(), True),
    ("tx_time_ns", T.ShortType(), True),
)

#: What is stored: an event, and the routing of an edge (null for documents).
STORED = T.StructType(LOG.fields + [T.StructField(n, T.StringType(), True) for n in ("from", "type", "to")])

#: Columns of a row result and of an edge result.
ROW = ["collection", "key", "value", "valid_from", "valid_from_ns", "tx_time", "tx_time_ns"]
EDGE = ["from", "type", "to", "props", "seq", "valid_from", "valid_from_ns", "tx_time", "tx_time_ns"]


def instant(name: str) -> Column:
    """The instant in ``name`` and ``name_ns``, as one value that compares."""
    return F.struct(F.col(name), F.coalesce(F.col(f"{name}_ns"), F.lit(0).cast("smallint")))
