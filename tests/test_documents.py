"""The two meanings of a condition, value by value."""

import pytest

from palimpsest.functions import documents as D

BIG = 9007199254740993
VALUES = {
    "text": '{"a": "x"}', "num": '{"a": 30}', "numtext": '{"a": "30"}', "true": '{"a": true}', "null": '{"a": null}', "missing": "{}",
    "array": '{"a": ["x", 30, null]}', "object": '{"a": {"p": "x", "q": 30}}', "big": '{"a": 9007199254740993}', "one": '{"a": 1}', "real": '{"a": 1.5}',
}
ALL = set(VALUES)
PRESENT = ALL - {"null", "missing"}
NUMBERS = {"num", "big", "one", "real"}

CASES = [
    # field op value, live, replay
    (("a", "!=", "x"), PRESENT - {"text"}, ALL - {"text"}),
    (("a", "=", None), {"null", "missing"}, {"null", "missing"}),
    (("a", "!=", None), PRESENT, PRESENT),
    (("a", "<", "m"), NUMBERS | {"true", "numtext", "array"}, set()),
    (("a", ">", 25), {"num", "big", "text", "numtext", "array", "object"}, {"num", "big"}),
    (("a", "<", 25), {"true", "one", "real"}, {"one", "real"}),
    (("a", "=", True), {"true", "one"}, {"true"}),
    (("a", "=", 1), {"true", "one"}, {"one"}),
    (("a", "=", "30"), {"numtext"}, {"numtext"}),
    (("a", "=", 30), {"num"}, {"num"}),
    (("a", "=", '["x",30,null]'), {"array"}, set()),
    (("a", "in", [30, "x"]), {"num", "text"}, {"num", "text"}),
    (("a", "in", []), set(), set()),
    (("a", "in", [None]), set(), {"null"}),
    (("a", "contains", "x"), {"text", "array", "object"}, {"array"}),
    (("a", "contains", 30), {"num", "array", "object"}, {"array"}),
    (("a", "contains", None), set(), {"array"}),
    (("a.q", "=", 30), {"object"}, {"object"}),
    (("a", "=", 9007199254740992), set(), {"big"}),
    (("a", ">", 9007199254740992), {"big", "text", "numtext", "array", "object"}, set()),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(VALUES.items()), "name string, value string").repartition(1).cache()


@pytest.mark.parametrize("term, live, replay", CASES, ids=[str(c[0]) for c in CASES])
def test_condition(docs, term, live, replay):
    from pyspark.sql import functions as F

    for mode, want in ((D.LIVE, live), (D.REPLAY, replay)):
        assert {r.name for r in docs.filter(D.matches(F.col("value"), [term], mode)).collect()} == want, mode


def test_conjunction(docs):
    from pyspark.sql import functions as F

    assert {r.name for r in docs.filter(D.matches(F.col("value"), [("a", ">", 1), ("a", "<", 31)], D.REPLAY)).collect()} == {"num", "real"}
    assert docs.filter(D.matches(F.col("value"), [], D.LIVE)).count() == len(VALUES)


def test_errors():
    from pyspark.sql import functions as F

    for bad in (("a", "in", 3), ("a", "=", [1]), ("a.", "=", 1), ("a..b", "=", 1), ("a", "~", 1), ("a", "=", {"x": 1})):
        with pytest.raises(ValueError):
            D.matches(F.lit("{}"), [bad], D.LIVE)


def test_replay_ignores_a_list_where_one_value_is_asked(docs):
    from pyspark.sql import functions as F

    assert docs.filter(D.matches(F.col("value"), [("a", "=", [1, 2])], D.REPLAY)).count() == 0
    assert docs.filter(D.matches(F.col("value"), [("a", "in", 1)], D.REPLAY)).count() == 0


@pytest.mark.parametrize("desc", [False, True])
def test_live_order(docs, desc):
    from pyspark.sql import functions as F

    got = [r.name for r in docs.orderBy(*D.order(F.col("value"), "a", desc, D.LIVE), "name").collect()]
    groups = [{"null", "missing"}, {"one", "true"}, {"real"}, {"num"}, {"big"}, {"numtext"}, {"array"}, {"text"}, {"object"}]
    groups = groups[::-1] if desc else groups
    at = 0
    for g in groups:
        assert set(got[at : at + len(g)]) == g
        at += len(g)


def test_replay_order(docs):
    from pyspark.sql import functions as F

    up = [r.name for r in docs.orderBy(*D.order(F.col("value"), "a", False, D.REPLAY), "name").collect()]
    down = [r.name for r in docs.orderBy(*D.order(F.col("value"), "a", True, D.REPLAY), "name").collect()]
    assert up[-1] == "missing" and down[0] == "missing"
    assert [x for x in up if x in NUMBERS] == ["one", "real", "num", "big"]
    assert [x for x in down if x in NUMBERS] == ["big", "num", "real", "one"]
