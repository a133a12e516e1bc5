"""Reads of documents: one key, or a collection with conditions, order and page."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..schema import ROW
from . import versions


#: What a read needs of a version; a pick carries all that it is given.
NEEDED = ["seq", "op", *ROW]


def page(rows: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """0 and None mean that no bound is given."""
    for n in (limit, offset):
        if n is not None and (not isinstance(n, int) or isinstance(n, bool) or n < 0):
            raise ValueError("LIMIT and OFFSET are whole numbers of 0 or more")
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit else rows


def get(log: DataFrame, collection: str, key: str, as_of=None, base: DataFrame | None = None) -> DataFrame:
    """The document at a key: the last committed version or, ``as_of`` a time, the one valid then."""
    one = lambda df: df.filter((F.col("collection") == collection) & (F.col("key") == str(key))).select(*NEEDED)
    if as_of is not None:
        return versions.visible(one(log), valid_at=as_of).select(*ROW)
    return versions.live(one(log), None if base is None else one(base)).select(*ROW)


def find(log: DataFrame, collection: str, where: Iterable = (), as_of=None, order_by: str | None = None, desc: bool = False, limit: int | None = None, offset: int | None = None, base: DataFrame | None = None) -> DataFrame:
    """The documents of a collection that meet all conditions. Without an order a page is one of keys in
    order, and a whole result is in no order: sorting it would be a shuffle for nothing."""
    one = lambda df: df.filter(F.col("collection") == collection).select(*NEEDED)
    mode = D.LIVE if as_of is None else D.REPLAY
    rows = versions.live(one(log), None if base is None else one(base)) if as_of is None else versions.visible(one(log), valid_at=as_of)
    rows = rows.filter(D.matches(F.col("value"), where, mode)).select(*ROW)
    if order_by is not None:
        rows = rows.orderBy(*D.order(F.col("value"), order_by, desc, mode), F.col("key"))
    elif limit or offset:
        rows = rows.orderBy("key")
    return page(rows, limit, offset)
