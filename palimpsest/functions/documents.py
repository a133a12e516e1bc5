"""Conditions and orders on fields of JSON documents, as column expressions.

Documents have no schema, so what a comparison means depends on the types met. Current state and past
states answer differently, and both answers are kept:

``LIVE`` (current state) orders values across types: missing and null lowest, then numbers (booleans
are 0 and 1), then text; arrays and objects count as their text. Anything compared with a missing value
is unknown and left out.

``REPLAY`` (a past state) compares like with like only: a number with a number, and so on; ``!=`` holds
for whatever isn't equal, a missing field included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

LIVE, REPLAY = "live", "replay"
OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "in", "contains")


@dataclass(frozen=True)
class Term:
    """``field op value``; the field is a dotted path, the value a literal or a list of literals."""

    field: str
    op: str
    value: Any

    def __post_init__(self):
        if self.op.lower() not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")
        if isinstance(self.value, dict) or isinstance(self.value, list) and any(isinstance(x, list | dict) for x in self.value):
            raise ValueError("a value is a string, number, boolean, null or a list of these")


def terms(where: Iterable) -> list[Term]:
    return [t if isinstance(t, Term) else Term(*t) for t in where or ()]


def path_of(field: str, mode: str = LIVE) -> str:
    parts = field.split(".")
    if any("'" in p or "\\" in p for p in parts) or mode == LIVE and not all(parts):
        raise ValueError(f"bad field {field!r}")
    return "$" + "".join(f"['{p}']" for p in parts)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


class _Value:
    """A variant and what it is, in the terms that comparisons need."""

    def __init__(self, variant: Column, kind: Column, text: Column):
        self.variant = variant
        self.kind = kind
        self.missing = kind.isNull()
        self.null = F.coalesce(kind == "VOID", F.lit(False))
        self.is_bool = F.coalesce(kind == "BOOLEAN", F.lit(False))
        self.is_int = F.coalesce(kind == "BIGINT", F.lit(False))
        self.is_number = F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))
        self.is_string = F.coalesce(kind == "STRING", F.lit(False))
        self.is_array = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
        self.is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
        self.number = F.when(self.is_number, F.try_variant_get(variant, "$", "double"))
        self.truth = F.when(self.is_bool, F.try_variant_get(variant, "$", "boolean"))
        self.string = F.when(self.is_string, F.try_variant_get(variant, "$", "string"))
        self.text = F.when(self.is_string, self.string).otherwise(text)

    def live(self) -> Column:
        """struct(rank, number, what the number leaves of a large integer, text)."""
        rank = F.when(self.missing | self.null, 0).when(self.is_number | self.is_bool, 1).otherwise(2)
        number = F.coalesce(self.number, self.truth.cast("double"), F.lit(0.0))
        whole = F.when(self.is_int, F.try_variant_get(self.variant, "$", "decimal(38,0)"))
        rest = F.coalesce((whole - F.when(self.is_int, number).cast("decimal(38,0)")).cast("bigint"), F.lit(0).cast("bigint"))
        return F.struct(rank.alias("rank"), number.alias("number"), rest.alias("rest"), F.when(rank == 2, F.coalesce(self.text, F.lit(""))).otherwise("").alias("text"))

    def equals(self, x: Any) -> Column:
        """Strict equality with a literal that isn't null."""
        if isinstance(x, bool):
            return F.coalesce(self.truth == F.lit(x), F.lit(False))
        if isinstance(x, int | float):
            return F.coalesce(self.number == F.lit(float(x)), F.lit(False))
        if isinstance(x, str):
            return F.coalesce(self.string == F.lit(x), F.lit(False))
        return F.lit(False)


def _live_literal(x: Any) -> Column:
    if isinstance(x, list):
        raise ValueError("a list can't be compared")
    text = x if isinstance(x, str) else ""
    number = 0.0 if isinstance(x, str) else float(x)
    return F.struct(F.lit(2 if isinstance(x, str) else 1).alias("rank"), F.lit(number).alias("number"), F.lit(0).cast("bigint").alias("rest"), F.lit(text).alias("text"))


_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _known(variant: Column, text: Callable[[Column], Column], use: Callable[[_Value], Column]) -> Column:
    return _bind(variant, lambda x: _bind(F.schema_of_variant(x), lambda kind: use(_Value(x, kind, text(x)))))


def _field(parsed: Column, document: Column, field: str, mode: str, use: Callable[[_Value], Column]) -> Column:
    """``use`` of a field of the document whose parsed form is given."""
    path = path_of(field, mode)
    return _known(F.try_variant_get(parsed, path, "variant"), lambda _: F.get_json_object(document, path), use)


def _element(x: Column, use: Callable[[_Value], Column]) -> Column:
    return _known(x, F.to_json, use)


def _live_equal(v: _Value, x: Any) -> Column:
    return _bind(v.live(), lambda at: (at["rank"] > 0) & (at == _live_literal(x)))


def _live(v: _Value, t: Term) -> Column:
    op, x = t.op.lower(), t.value
    if op in ("=", "!=") and x is None:
        return (v.missing | v.null) if op == "=" else ~(v.missing | v.null)
    if op in _COMPARE:
        literal = None if x is None else _live_literal(x)
        return F.lit(False) if x is None else _bind(v.live(), lambda at: (at["rank"] > 0) & _COMPARE[op](at, literal))
    if op == "in":
        if not isinstance(x, list):
            raise ValueError("IN takes a list")
        wanted = [_live_literal(y) for y in x if y is not None]
        return _bind(v.live(), lambda at: (at["rank"] > 0) & reduce(lambda a, b: a | b, [at == y for y in wanted], F.lit(False)))
    if x is None:
        return F.lit(False)
    if isinstance(x, list):
        raise ValueError("CONTAINS takes one value")
    some = lambda items: F.coalesce(F.exists(items, lambda e: _element(e, lambda w: _live_equal(w, x))), F.lit(False))
    array = F.try_variant_get(F.when(v.is_array, v.variant), "$", "array<variant>")
    members = F.map_values(F.try_variant_get(F.when(v.is_object, v.variant), "$", "map<string,variant>"))
    return F.when(v.is_array, some(array)).when(v.is_object, some(members)).otherwise(_live_equal(v, x))


def _replay(v: _Value, t: Term) -> Column:
    op, x = t.op.lower(), t.value
    if op in ("=", "!="):
        equal = (v.missing | v.null) if x is None else v.equals(x)
        return equal if op == "=" else ~equal
    if op in _COMPARE:
        number = isinstance(x, int | float) and not isinstance(x, bool)
        return F.coalesce(_COMPARE[op](v.number, F.lit(float(x))), F.lit(False)) if number else F.lit(False)
    if op == "in":
        same = [v.null if y is None else v.equals(y) for y in x] if isinstance(x, list) else []
        return reduce(lambda a, b: a | b, same, F.lit(False))
    array = F.try_variant_get(F.when(v.is_array, v.variant), "$", "array<variant>")
    return F.coalesce(F.exists(array, lambda e: F.is_variant_null(e) if x is None else _element(e, lambda w: w.equals(x))), F.lit(False))


def matches(document: Column, where: Iterable, mode: str) -> Column:
    """True where all terms hold; never null. The document is parsed once, and each field is looked at once."""
    one = _live if mode == LIVE else _replay
    fields: dict[str, list[Term]] = {}
    for t in terms(where):
        fields.setdefault(t.field, []).append(t)
    if not fields:
        return F.lit(True)
    both = lambda found: reduce(lambda a, b: a & b, found)
    of_field = lambda ts: lambda v: both([F.coalesce(one(v, t), F.lit(False)) for t in ts])
    return _bind(F.try_parse_json(document), lambda parsed: both([_field(parsed, document, f, mode, of_field(ts)) for f, ts in fields.items()]))


def order(document: Column, field: str, desc: bool, mode: str) -> list[Column]:
    """Sort columns by a field; the caller adds what breaks ties.

    LIVE puts missing and null first ascending and last descending; REPLAY puts missing last ascending
    and first descending, and ranks types it has no order for: null, boolean, number, text, others."""
    if mode == LIVE:
        key = lambda v: v.live()
    else:
        kind = lambda v: F.when(v.missing, 9).when(v.null, 0).when(v.is_bool, 1).when(v.is_number, 2).when(v.is_string, 3).otherwise(4)
        key = lambda v: F.struct(kind(v), F.coalesce(v.number, F.lit(0.0)), F.coalesce(v.string, F.lit("")))
    # one value that compares part by part
    found = _bind(F.try_parse_json(document), lambda parsed: _field(parsed, document, field, mode, key))
    return [found.desc() if desc else found.asc()]


def valid_document(text: Column) -> Column:
    """True for the text of a JSON object without repeated keys."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))
