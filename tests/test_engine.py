"""Writes, reads of past states, graph, search, purges, shipping and restores."""

from datetime import datetime, timedelta

import pytest

from palimpsest.database import Database
from palimpsest.functions import instants
from palimpsest.operators import search, versions
from palimpsest.schema import LOG
from palimpsest.sources import EventLog
from palimpsest.streaming.shipping import FolderSink

T1, T2, T3 = datetime(2026, 1, 1), datetime(2026, 2, 1), datetime(2026, 3, 1)


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def keys(df):
    return [r.key for r in df.collect()]


def values(df):
    import json

    return [None if r.value is None else json.loads(r.value) for r in df.collect()]


def event(seq, key="1", op="put", value='{"v":1}', at=T1, ns=0, tx=None, collection="users"):
    tx = tx or at
    return (seq, collection, key, op, value if op == "put" else None, "{}", at, ns, tx, 0)


def log_of(spark, *events):
    return spark.createDataFrame(list(events), LOG)


# instants


def test_instants():
    p = instants.parse
    assert p("2026-01-01") == p("2026-01-01T00:00:00Z") == p("2026-01-01T02:00:00+02:00")
    assert p("2026-01-01T00:00:00.123456789Z") == instants.Instant(datetime(2026, 1, 1, 0, 0, 0, 123456), 789)
    assert str(p("2026-01-01T00:00:00.1Z")) == "2026-01-01T00:00:00.100000000Z"
    for bad in ("2026", "2026-01-01 00:00:00", "2026-01-01T00:00:00", "x"):
        with pytest.raises(ValueError):
            p(bad)
    late = instants.Instant(datetime(9000, 1, 1), 999)
    assert instants.now(late) > late


# picks


def test_boundary_is_half_open_to_the_nanosecond(spark):
    log = log_of(spark, event(1, value='{"v":1}', at=T1), event(2, value='{"v":2}', at=T2))
    assert values(versions.visible(log, valid_at=T2)) == [{"v": 2}]
    before = instants.Instant(T2 - timedelta(microseconds=1), 999)
    assert values(versions.visible(log, valid_at=before)) == [{"v": 1}]
    assert values(versions.visible(log, valid_at=datetime(2025, 1, 1))) == []


def test_ties_go_to_the_last_commit_and_future_commits_are_unknown(spark):
    log = log_of(spark, event(1, value='{"v":1}'), event(2, value='{"v":2}'), event(3, value='{"v":3}', at=T1, tx=T3))
    assert values(versions.visible(log, valid_at=T1)) == [{"v": 3}]
    assert values(versions.visible(log, valid_at=T1, as_of=T2)) == [{"v": 2}]
    assert values(versions.visible(log, as_of="0001-01-01")) == [{"v": 3}]


def test_current_is_last_committed_not_latest_valid(spark):
    log = log_of(spark, event(1, value='{"v":"new"}', at=T2, tx=T1), event(2, value='{"v":"backdated"}', at=T1, tx=T2))
    assert values(versions.live(log)) == [{"v": "backdated"}]
    assert values(versions.visible(log, valid_at=T3)) == [{"v": "new"}]


def test_tombstones_are_dropped_after_the_pick(spark):
    log = log_of(spark, event(1), event(2, op="delete", at=T2), event(3, key="2"))
    assert keys(versions.visible(log, valid_at=T2)) == ["2"]
    assert sorted(keys(versions.visible(log, valid_at=T1))) == ["1", "2"]
    assert versions.visible(log, valid_at=T2, tombstones=True).count() == 2


# documents


def test_put_get_delete_history(db):
    db.put("users", 1, {"name": "Ada"})
    assert values(db.get("users", 1)) == [{"name": "Ada"}]
    db.put("users", "1", '{"name":"Ada L."}')
    db.delete("users", "1")
    db.delete("users", "never there")
    assert values(db.get("users", "1")) == [] == values(db.get("users", "2"))
    assert values(db.history("users", "1")) == [{"name": "Ada"}, {"name": "Ada L."}, None]


def test_backdated_versions(db):
    db.put("users", "1", {"v": 1}, at="2020-01-01")
    db.put("users", "1", {"v": 2}, at="2020-06-01")
    assert values(db.get("users", "1", as_of="2020-03-01")) == [{"v": 1}]
    assert values(db.find("users", as_of="2020-07-01")) == [{"v": 2}]
    db.put("users", "1", {"v": 0}, at="2019-01-01")
    assert values(db.get("users", "1")) == [{"v": 0}]
    assert values(db.history("users", "1", ("2020-01-01", "2020-06-01"))) == [{"v": 1}, {"v": 2}]


def test_future_versions_are_current_at_once(db):
    db.put("users", "1", {"v": 1}, at="2999-01-01")
    assert values(db.get("users", "1")) == [{"v": 1}]
    assert values(db.get("users", "1", as_of="2030-01-01")) == []


def test_find_pages(db):
    for k, v in (("a", 1), ("b", 2), ("c", 3)):
        db.put("users", k, {"v": v})
    assert keys(db.find("users", order_by="v", desc=True, limit=1, offset=1)) == ["b"]
    assert keys(db.find("users", order_by="v", limit=0, offset=0)) == ["a", "b", "c"]
    assert keys(db.find("users", [("v", ">", 1)], order_by="v")) == ["b", "c"]
    assert keys(db.find("users", order_by="v", offset=2)) == ["c"]
    for bad in (-1, 1.5):
        with pytest.raises(ValueError):
            db.find("users", limit=bad)


def test_bad_writes(db):
    for bad in ("[1]", '{"a":1,"a":2}', '{"a":NaN}', "3"):
        with pytest.raises(ValueError):
            db.put("users", "1", bad)
    with pytest.raises(ValueError):
        db.put("", "1", {})
    assert db.events.log().count() == 0


def test_sequence_numbers_and_times_rise(db):
    from threading import Thread

    threads = [Thread(target=lambda i=i: db.put("users", i, {"v": i})) for i in range(20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = db.events.log().orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 21))
    times = [(r.tx_time, r.tx_time_ns) for r in rows]
    assert times == sorted(set(times))


def test_load(spark, db):
    db.put("users", "0", {"v": 0})
    db.events.load(spark.range(100).selectExpr("'users' as collection", "id + 1 as key", "to_json(struct(id as v)) as value"))
    assert db.find("users").count() == 101
    db.put("users", "0", {"v": 9})
    assert values(db.get("users", 0)) == [{"v": 9}]


def test_load_checks_documents(spark, db):
    for bad in ("[1]", '{"a":1,"a":2}', '{"a":NaN}', "3", None):
        rows = spark.createDataFrame([("users", "1", '{"v":1}'), ("users", "2", bad)], "collection string, key string, value string")
        with pytest.raises(Exception, match="not a document"):
            db.events.load(rows)
    assert db.find("users").count() == 0 and db.events.last_seq() == 0
    db.put("users", "1", {"v": 1})
    before = instants.now()
    db.events.load(spark.createDataFrame([("users", "2", '{"v":2}')], "collection string, key string, value string"))
    assert keys(db.find("users", as_of=before)) == ["1"]
    (row,) = db.history("users", "2").collect()
    assert (row.valid_from, row.valid_from_ns) == (row.tx_time, row.tx_time_ns)


def test_what_is_acknowledged_outlives_its_writer(spark, tmp_path):
    root = str(tmp_path / "db")
    db = Database(spark, root)
    db.put("users", "1", {"v": 1})
    db.delete("users", "1")
    db.put("users", "2", {"v": 2})
    del db  # without any farewell
    again = Database(spark, root)
    assert keys(again.find("users")) == ["2"] and again.events.last_seq() == 3


def test_a_batch_is_all_or_nothing(db):
    db.put("users", "0", {"v": 0})
    with pytest.raises(ZeroDivisionError), db.events.batch():
        db.put("users", "1", {"v": 1})
        raise ZeroDivisionError
    assert keys(db.find("users")) == ["0"] and db.events.last_seq() == 1
    with db.events.batch():
        db.put("users", "1", {"v": 1})
        assert keys(db.find("users")) == ["0"]
        db.put("users", "2", {"v": 2})
    assert sorted(keys(db.find("users"))) == ["0", "1", "2"]
    assert [r.seq for r in db.events.log().orderBy("seq").collect()] == [1, 2, 3]


def test_current_state_is_stored(spark, db):
    db.events.load(spark.range(50).selectExpr("'users' as collection", "id as key", "to_json(struct(id as v)) as value"))
    db.delete("users", 7)
    assert not db.events.keep_state() and db.events.keep_state(force=True)
    assert db.find("users").count() == 49
    db.put("users", 8, {"v": 800})
    db.delete("users", 9)
    assert values(db.find("users", [("v", ">", 100)])) == [{"v": 800}]
    assert db.find("users").count() == 48
    plan = db.events.recent()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(seq" in plan  # the scan skips history
    # a state that broke off isn't complete and doesn't count
    seq = db.events.last_seq()
    db.events._mark(f"{db.events.generation}/state/{seq}/part-0")
    assert db.find("users").count() == 48
    assert db.events.keep_state(force=True) and db.find("users").count() == 48
    assert Database(spark, db.events.root).find("users").count() == 48


def test_sweep_rewrites_once(db):
    for c in ("a", "b", "c"):
        db.put(c, "1", {"v": 1})
    assert db.retain(timedelta(days=-1)) == {"a": 1, "b": 1, "c": 1}
    assert db.events.generation == "gen-1" and db.events.log().count() == 0
    assert all(values(db.get(c, "1")) == [{"v": 1}] for c in ("a", "b", "c"))
    db.purge("a", "2999-01-01")
    assert db.events.generation == "gen-1"  # nothing goes


def test_a_sweep_that_breaks_off_changes_nothing(db):
    db.put("users", "1", {"v": 1})
    db.events._mark("gen-1/log/collection=users/part-0")
    assert db.events.generation == "gen-0" and len(values(db.history("users", "1"))) == 1
    assert db.purge("users", "2999-01-01") == 1 and values(db.get("users", "1")) == [{"v": 1}]


def test_routing_reaches_the_scan(spark, db):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    db.relate("users/1", "knows", "users/2")
    plan = db.related("users/1", ["knows"], "out")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(from,users/1)" in plan and "EqualTo(type,knows)" in plan and "from_json" not in plan


# graph


def test_graph(db):
    db.relate("users/1", "knows", "users/2", {"since": 2020})
    db.relate("users/1", "blocks", "users/3")
    db.relate("users/3", "knows", "users/1")
    db.relate("users/4", "likes", "users/4")
    pairs = lambda df: [(r["from"], r["type"], r["to"]) for r in df.collect()]
    assert pairs(db.related("users/1", direction="out")) == [("users/1", "knows", "users/2"), ("users/1", "blocks", "users/3")]
    assert pairs(db.related("users/1", direction="in")) == [("users/3", "knows", "users/1")]
    assert len(pairs(db.related("users/1"))) == 3
    assert pairs(db.related("users/4")) == [("users/4", "likes", "users/4")]
    assert pairs(db.related("users/1", ["knows"], limit=1, offset=1)) == [("users/3", "knows", "users/1")]
    assert [r.type for r in db.edge_types().collect()] == ["blocks", "knows", "likes"]
    db.relate("users/1", "knows", "users/2", {"since": 2021})
    assert pairs(db.related("users/1", direction="out"))[-1] == ("users/1", "knows", "users/2")
    moment = instants.now()
    db.unrelate("users/1", "knows", "users/2")
    assert len(pairs(db.related("users/1"))) == 2
    assert len(pairs(db.related("users/1", as_of=moment))) == 3
    db.put("__edges__", "raw", {"x": 1})
    assert [r.type for r in db.edge_types().collect()] == ["blocks", "knows", "likes"]


def test_edge_keys_agree(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions.edges import edge_key

    for parts in (("a/1", "t", "b/2"), ("a/1t", "", "é/ü"), ("", "a/1t", "éü/")):
        want, _ = EventLog._edge_parts(*parts)
        assert spark.range(1).select(edge_key(*map(F.lit, parts))).first()[0] == want


# search


def test_search(spark, tmp_path):
    from palimpsest.database import Settings

    points = spark.createDataFrame([("docs", str(k), v, s) for k, v, s in ((1, [0.0, 1.0], 1), (2, [0.6, 0.8], 2), (3, [1.0, 0.0], 3), (4, [1.0, 0.1], 4), (3, [0.99, 0.1], 5))], "collection string, key string, embedding array<float>, seq long")
    db = Database(spark, str(tmp_path / "db"), Settings(searcher=lambda texts: [[1.0, 0.0] for _ in texts]), points)
    for k in (1, 2, 3):
        db.put("docs", k, {"v": k, "lang": "en" if k != 2 else "fr"})
    assert keys(db.search("docs", "x")) == ["3", "2", "1"]  # 4 has no document
    assert keys(db.search("docs", "x", limit=2)) == ["3"]
    assert keys(db.search("docs", "x", limit=1, offset=2)) == ["2"]
    assert keys(db.search("docs", "x", offset=3)) == ["1"]
    assert keys(db.search("docs", "x", [("lang", "=", "en")])) == ["3", "1"]
    with pytest.raises(ValueError, match="not configured"):
        Database(spark, str(tmp_path / "other")).search("docs", "x")
    with pytest.raises(ValueError):
        search.embed(lambda texts: [], "x")


def test_vectors_are_written_in_batches(spark, tmp_path):
    from palimpsest.database import Settings

    where = {"north": [0.0, 1.0], "east": [1.0, 0.0], "query": [1.0, 0.1], "long": [1.0, 0.0, 0.0]}
    db = Database(spark, str(tmp_path / "db"), Settings(searcher=lambda texts: [where[t] for t in texts], dimension=2))
    assert db.search("docs", "query").count() == 0
    for k in (1, 2):
        db.put("docs", k, {"v": k})
    rows = lambda *r: spark.createDataFrame(list(r), "key string, text string")
    db.index("docs", rows(("1", "east"), ("2", "north")))
    assert keys(db.search("docs", "query")) == ["1", "2"]
    db.index("docs", rows(("1", "north"), ("2", "east"), (None, "east")))
    assert keys(db.search("docs", "query", limit=1)) == ["2"]
    with pytest.raises(Exception, match="dimensions"):
        db.index("docs", rows(("1", "east"), ("2", "long")))
    assert keys(db.search("docs", "query")) == ["2", "1"]
    db.index("docs", rows(("1", "east")).limit(0))
    with pytest.raises(ValueError, match="not configured"):
        Database(spark, str(tmp_path / "other")).index("docs", rows(("1", "east")))


def test_rerank(spark, tmp_path):
    from pyspark.sql import functions as F

    from palimpsest.database import Settings

    points = spark.createDataFrame([("docs", str(k), [1.0, float(k)], k) for k in (1, 2, 3)], "collection string, key string, embedding array<float>, seq long")
    turned = lambda best: best.withColumn("rank", F.lit(4) - F.col("rank"))
    db = Database(spark, str(tmp_path / "db"), Settings(searcher=lambda texts: [[1.0, 0.0]], reranker=turned), points)
    with db.events.batch():
        for k in (1, 2, 3):
            db.put("docs", k, {"v": k})
    assert keys(db.search("docs", "x")) == ["3", "2", "1"]


def test_pages_of_plain_values(db, monkeypatch):
    import palimpsest.database as D

    monkeypatch.setattr(D, "PAGE", 2)
    with db.events.batch():
        for k in (1, 2, 3):
            db.put("users", k, {"v": k})
    assert "more than 2 rows" in db.run([("find", "users")])["error"]
    assert len(db.run([("find", "users", {"limit": 2})])["results"][0]["rows"]) == 2


# purges


def test_purge_keeps_current_state(db):
    db.put("users", "1", {"v": 1})
    db.put("users", "1", {"v": 2})
    db.put("orders", "1", {"v": 3})
    assert db.purge("users", "2999-01-01") == 2
    assert values(db.get("users", "1")) == [{"v": 2}]
    assert values(db.history("users", "1")) == [] == values(db.get("users", "1", as_of="2998-01-01"))
    assert len(values(db.history("orders", "1"))) == 1
    db.put("users", "1", {"v": 4})
    assert db.events.log().filter("collection = 'users'").first().seq == 4
    assert db.purge("users", "2000-01-01") == 0
    assert values(db.get("users", "1")) == [{"v": 4}]


def test_retain(db):
    db.put("users", "1", {"v": 1})
    db.put("orders", "1", {"v": 1})
    assert db.retain() == {}
    assert db.retain(timedelta(days=1)) == {"users": 0, "orders": 0}
    assert db.retain(timedelta(days=-1)) == {"users": 1, "orders": 1}


# backups


def test_shipping_once_snapshot_restore(spark, tmp_path):
    sink = FolderSink(spark, str(tmp_path / "sink"))
    db = Database(spark, str(tmp_path / "db"), sink=sink)
    db.put("users", "1", {"v": 1}, at="2020-01-01")
    sink.ship(db.events)
    assert sink.shipped().count() == 1
    sink.ship(db.events)
    assert sink.shipped().count() == 1
    name = sink.snapshot(db.events)
    assert sink.snapshots()[0][0] == 1 and sink.snapshots()[0][2] == name
    db.put("users", "1", {"v": 2}, at="2020-06-01")
    db.put("users", "2", {"v": 5})
    sink.ship(db.events)
    assert sink.last_seq() == 3
    target = instants.now()
    db.put("users", "3", {"v": 6})
    sink.ship(db.events)
    back = Database(spark, str(tmp_path / "back"))
    with pytest.raises(ValueError):
        sink.restore(str(tmp_path / "back"), target)
    sink.restore(str(tmp_path / "restored"), target)
    back = Database(spark, str(tmp_path / "restored"))
    assert sorted(keys(back.find("users"))) == ["1", "2"]
    assert values(back.get("users", "1", as_of="2020-03-01")) == [{"v": 1}]
    assert values(back.history("users", "1")) == values(db.history("users", "1"))
    back.put("users", "9", {"v": 9})
    assert back.events.last_seq() == 4


def test_purge_prunes_what_was_shipped(spark, tmp_path):
    sink = FolderSink(spark, str(tmp_path / "sink"))
    db = Database(spark, str(tmp_path / "db"), sink=sink)
    db.put("users", "1", {"v": 1})
    db.put("orders", "1", {"v": 1})
    sink.ship(db.events)
    cutoff = instants.now()
    db.put("users", "2", {"v": 2})
    sink.ship(db.events)
    db.purge("users", cutoff)
    assert [r.seq for r in sink.shipped().collect()] == [3]
    sink.ship(db.events)
    db.put("users", "3", {"v": 3})
    sink.ship(db.events)
    assert sorted(r.seq for r in sink.shipped().collect()) == [3, 4]


def test_restore_without_anything(spark, tmp_path):
    sink = FolderSink(spark, str(tmp_path / "sink"))
    back = sink.restore(str(tmp_path / "back"), "2026-01-01")
    assert back.log().count() == 0


# several calls


def test_run_stops_at_the_first_error(db):
    out = db.run([("put", "users", "1", {"v": 1}), ("get", "users", "1"), ("find", "users", [("v", "in", 3)]), ("get", "users", "1")])
    assert out["results"][0] == {} and out["results"][1]["rows"][0]["value"] == {"v": 1}
    assert len(out["results"]) == 2 and "list" in out["error"]
    assert db.run([("nothing",)])["error"]
    assert db.run([("get", "users", "none"), ("edge_types",), ("purge", "users", "2000-01-01")])["results"] == [{}, {"edge_types": []}, {"purged": 0}]


def test_plans_have_no_shuffle_for_one_key(spark):
    from palimpsest.operators import documents
    from palimpsest.plans import tables

    plan = documents.get(tables.users(spark, "/root/testdata/sf0.001"), "users", "5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo" in plan or "user_id" in plan


def test_intervals_of_a_hot_key(spark):
    """A key's days are joined to the days after them; several versions of a moment, gaps and other keys too."""
    import datetime
    import random

    from palimpsest.operators import versions
    from palimpsest.schema import LOG

    rnd = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    log = []
    for seq in range(600):
        at = start + datetime.timedelta(days=rnd.choice([0, 0, 1, 5, 30]), hours=rnd.randrange(3))
        log.append((seq, "c", "hot" if seq % 3 else f"k{seq % 7}", "put", "{}", None, at, rnd.choice([0, 500]), at, 0))
    found = versions.intervals(spark.createDataFrame(log, LOG))
    assert found.columns == [*LOG.names, "valid_to", "valid_to_ns"]
    ends = {}
    for key in {r[2] for r in log}:
        mine = sorted((r[6], r[7], r[0]) for r in log if r[2] == key)
        ends |= {a[2]: b[:2] for a, b in zip(mine, [*mine[1:], (None, None)], strict=True)}
    assert {r.seq: (r.valid_to, r.valid_to_ns) for r in found.collect()} == ends
