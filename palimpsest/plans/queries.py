"""One query per operator over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..database import Database
from ..functions.instants import parse
from ..operators import documents, graph, retention, search, versions
from ..schema import LOG as SCHEMA
from ..sources.event_log import EventLog
from ..sources.vectors import VectorStore
from ..streaming.shipping import FolderSink
from . import tables as t

AT = "2024-01-20"
CUTOFF = "2024-01-15"

LOG = """
WITH log AS (
    SELECT event_id AS seq, 'users' AS collection, CAST(user_id AS VARCHAR) AS key,
        CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
        CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value,
        ts AS tx_time, ts - to_days(CAST(event_id % 7 AS INTEGER)) AS valid_from,
        CAST(json_extract(CASE WHEN event_type = 'error' THEN NULL ELSE props END, '$.k') AS BIGINT) AS k
    FROM events
)"""
VALID = LOG + f""", past AS (
    SELECT * FROM log a WHERE valid_from <= TIMESTAMP '{AT}' AND NOT EXISTS (
        SELECT 1 FROM log b WHERE b.key = a.key AND b.valid_from <= TIMESTAMP '{AT}'
            AND (b.valid_from > a.valid_from OR b.valid_from = a.valid_from AND b.seq > a.seq))
        AND op = 'put'
)"""
LIVE = LOG + """, live AS (
    SELECT l.* FROM log l JOIN (SELECT key, max(seq) AS seq FROM log GROUP BY key) m ON l.key = m.key AND l.seq = m.seq WHERE op = 'put'
)"""
ROW = "key, value, valid_from, tx_time"
DOCS = """
WITH docs AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS key, d.lang, d.source, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 10 <> 0)"""
_ENDS = """'customer/' || o_custkey AS "from", CASE WHEN o_orderkey % 7 = 0 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'fulfilled' ELSE 'placed' END AS type, 'orders/' || o_orderkey AS "to\""""
EDGES = f"""
WITH elog AS (
    SELECT {_ENDS}, '{{"priority":"old"}}' AS props, 3 * o_orderkey AS seq, o_orderdate - INTERVAL 30 DAY AS valid_from, 'put' AS op FROM orders
    UNION ALL SELECT {_ENDS}, '{{"priority":"' || o_orderpriority || '"}}', 3 * o_orderkey + 1, o_orderdate, 'put' FROM orders
    UNION ALL SELECT {_ENDS}, NULL, 3 * o_orderkey + 2, o_orderdate + INTERVAL 10 DAY, 'delete' FROM orders WHERE o_orderkey % 7 = 0
), edges AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "to" ORDER BY seq DESC) AS n FROM elog) WHERE n = 1 AND op = 'put'
), past AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "to" ORDER BY valid_from DESC, seq DESC) AS n FROM elog WHERE valid_from <= TIMESTAMP '1997-01-01') WHERE n = 1 AND op = 'put'
)"""


def _row(df: DataFrame) -> DataFrame:
    return df.select("key", "value", "valid_from", "tx_time")


def _edge(df: DataFrame) -> DataFrame:
    return df.select("from", "type", "to", "props", "seq", "valid_from")


Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(name: str, sql: str | None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


@_query("find_as_of", f"{VALID} SELECT {ROW} FROM past")
def _(s, d):
    return _row(documents.find(t.users(s, d), "users", as_of=AT))


@_query("find_as_of_where", f"{VALID} SELECT {ROW} FROM past WHERE k > 50")
def _(s, d):
    return _row(documents.find(t.users(s, d), "users", [("k", ">", 50)], as_of=AT))


@_query("find_as_of_order_page", f"{VALID} SELECT {ROW} FROM past ORDER BY k DESC, key LIMIT 15 OFFSET 5")
def _(s, d):
    return _row(documents.find(t.users(s, d), "users", as_of=AT, order_by="k", desc=True, limit=15, offset=5))


@_query("find_as_of_not_equal", f"{VALID} SELECT {ROW} FROM past WHERE k IS NULL OR k <> 7")
def _(s, d):
    return _row(documents.find(t.users(s, d), "users", [("k", "!=", 7)], as_of=AT))


@_query("get_current", f"{LIVE} SELECT {ROW} FROM live WHERE key = '7'")
def _(s, d):
    return _row(documents.get(t.users(s, d), "users", "7"))


@_query("get_as_of", f"{VALID} SELECT {ROW} FROM past WHERE key = '7'")
def _(s, d):
    return _row(documents.get(t.users(s, d), "users", "7", as_of=AT))


@_query("live_projection", f"{LIVE} SELECT {ROW} FROM live")
def _(s, d):
    return _row(versions.live(t.users(s, d)))


@_query("find_where_num", f"{LIVE} SELECT {ROW} FROM live WHERE k >= 25 AND k < 75")
def _(s, d):
    return _row(documents.find(t.users(s, d), "users", [("k", ">=", 25), ("k", "<", 75)]))


@_query("find_order_page", f"{LIVE} SELECT {ROW} FROM live ORDER BY k DESC NULLS LAST, key LIMIT 10 OFFSET 3")
def _(s, d):
    return _row(documents.find(t.users(s, d), "users", order_by="k", desc=True, limit=10, offset=3))


@_query("find_where_str", f"{DOCS} SELECT key FROM docs WHERE lang = 'fr' AND n_chars > 500")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", [("lang", "=", "fr"), ("n_chars", ">", 500)]).select("key")


@_query("find_text_range", f"{DOCS} SELECT key FROM docs WHERE source >= 'src15' AND source < 'src3'")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", [("origin.source", ">=", "src15"), ("origin.source", "<", "src3")]).select("key")


@_query("find_in", f"{DOCS} SELECT key FROM docs WHERE lang IN ('de', 'es')")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", [("lang", "in", ["de", "es", None])]).select("key")


@_query("find_null", f"{DOCS} SELECT key FROM docs WHERE quality IS NULL")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", [("quality", "=", None)]).select("key")


@_query("find_neq_live", f"{DOCS} SELECT key FROM docs WHERE quality <> 1")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", [("quality", "!=", 1)]).select("key")


@_query("find_neq_replay", f"{DOCS} SELECT key FROM docs WHERE quality <> 1 OR quality IS NULL")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", [("quality", "!=", 1)], as_of="2024-02-01").select("key")


@_query("find_text_above_number", f"{DOCS} SELECT key FROM docs WHERE lang IS NOT NULL")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", [("lang", ">", 25)]).select("key")


@_query("find_contains", f"{DOCS} SELECT key FROM docs WHERE source = 'src7'")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", [("tags", "contains", "src7")]).select("key")


@_query("find_contains_member", f"{DOCS} SELECT key FROM docs WHERE source = 'src7'")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", [("origin", "contains", "src7")]).select("key")


@_query("find_order_missing", f"{DOCS} SELECT key FROM docs ORDER BY quality ASC NULLS FIRST, key LIMIT 700")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", order_by="quality", limit=700).select("key")


@_query("find_order_missing_replay", f"{DOCS} SELECT key FROM docs ORDER BY quality DESC NULLS FIRST, key LIMIT 700")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", order_by="quality", desc=True, as_of="2024-02-01", limit=700).select("key")


@_query("history", f"{LOG} SELECT seq, {ROW} FROM log WHERE key = '7'")
def _(s, d):
    return versions.history(t.users(s, d), "users", "7").select("seq", "key", "value", "valid_from", "tx_time")


@_query("history_between", f"{LOG} SELECT seq, {ROW} FROM log WHERE key = '7' AND valid_from BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '{AT}'")
def _(s, d):
    return versions.history(t.users(s, d), "users", "7", ("2024-01-05", AT)).select("seq", "key", "value", "valid_from", "tx_time")


@_query("validity_intervals", f"{LOG} SELECT seq, key, valid_from, lead(valid_from) OVER (PARTITION BY key ORDER BY valid_from, seq) AS valid_to FROM log")
def _(s, d):
    return versions.intervals(t.users(s, d)).select("seq", "key", "valid_from", "valid_to")


@_query("tx_as_of", f"""{LOG} SELECT key, value, valid_from, tx_time FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY valid_from DESC, seq DESC) AS n FROM log
    WHERE tx_time <= TIMESTAMP '{CUTOFF}' AND valid_from <= TIMESTAMP '{CUTOFF}') WHERE n = 1 AND op = 'put'""")
def _(s, d):
    return _row(versions.visible(t.users(s, d), as_of=CUTOFF))


@_query("bitemporal", f"""{LOG} SELECT key, value, valid_from, tx_time FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY valid_from DESC, seq DESC) AS n FROM log
    WHERE tx_time <= TIMESTAMP '{AT}' AND valid_from <= TIMESTAMP '2024-01-10') WHERE n = 1 AND op = 'put'""")
def _(s, d):
    return _row(versions.visible(t.users(s, d), valid_at="2024-01-10", as_of=AT))


@_query("latest_by_valid_time", f"{LOG} SELECT key, value, valid_from, tx_time FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY valid_from DESC, seq DESC) AS n FROM log) WHERE n = 1 AND op = 'put'")
def _(s, d):
    return _row(versions.visible(t.users(s, d)))


@_query("point_in_time", f"""{LOG}, asked AS (SELECT CAST(user_id AS VARCHAR) AS key, ts AS "at" FROM events WHERE event_type = 'click')
SELECT a.key, a."at", CASE WHEN l.op = 'put' THEN l.value END AS value, CASE WHEN l.op = 'put' THEN l.seq END AS seq FROM asked a LEFT JOIN LATERAL (
    SELECT * FROM log WHERE log.key = a.key AND log.valid_from <= a."at" ORDER BY log.valid_from DESC, log.seq DESC LIMIT 1) l ON true""")
def _(s, d):
    asked = t.table(s, d, "events").filter("event_type = 'click'").select(F.lit("users").alias("collection"), F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"))
    return versions.valid_when(t.users(s, d), asked).select("key", "at", "value", "seq")


@_query("after_seq", f"{LOG} SELECT seq, op, {ROW} FROM log WHERE seq > 500")
def _(s, d):
    return versions.after(t.users(s, d), 500).select("seq", "op", "key", "value", "valid_from", "tx_time")


@_query("purge_survivors", f"{LOG} SELECT seq, key FROM log WHERE tx_time >= TIMESTAMP '{CUTOFF}'")
def _(s, d):
    return retention.survivors(t.users(s, d), CUTOFF, "users").select("seq", "key")


@_query("purge_count", f"{LOG} SELECT count(*) AS purged FROM log WHERE tx_time < TIMESTAMP '{CUTOFF}'")
def _(s, d):
    return retention.purged(t.users(s, d), "users", CUTOFF)


@_query("live_after_purge", f"{LIVE} SELECT {ROW} FROM live")
def _(s, d):
    log = t.users(s, d)
    return _row(versions.live(retention.survivors(log, CUTOFF, "users"), versions.latest(log)))


@_query("find_as_of_after_purge", f"""{LOG} SELECT {ROW} FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY valid_from DESC, seq DESC) AS n FROM log
    WHERE tx_time >= TIMESTAMP '{CUTOFF}' AND valid_from <= TIMESTAMP '{AT}') WHERE n = 1 AND op = 'put'""")
def _(s, d):
    return _row(documents.find(retention.survivors(t.users(s, d), CUTOFF, "users"), "users", as_of=AT))


@_query("collection_list", "SELECT unnest(['__edges__', 'docs', 'users']) AS collection")
def _(s, d):
    return retention.collections(t.users(s, d).unionByName(t.docs(s, d)).unionByName(t.orders(s, d).select(*SCHEMA.names)))


@_query("high_water_seq", f"{LOG} SELECT CAST(coalesce(max(seq), 0) AS BIGINT) AS seq FROM log")
def _(s, d):
    return retention.high_water(t.users(s, d))


_EDGE = '"from", type, "to", props, seq, valid_from'


@_query("related_out", f"{EDGES} SELECT {_EDGE} FROM edges WHERE \"from\" = 'customer/7'")
def _(s, d):
    return _edge(graph.related(t.orders(s, d), "customer/7", direction="out"))


@_query("related_in", f"{EDGES} SELECT {_EDGE} FROM edges WHERE \"to\" = 'orders/9'")
def _(s, d):
    return _edge(graph.related(t.orders(s, d), "orders/9", direction="in"))


@_query("related_both", f"{EDGES} SELECT {_EDGE} FROM edges WHERE \"from\" = 'customer/7' OR \"to\" = 'customer/7'")
def _(s, d):
    return _edge(graph.related(t.orders(s, d), "customer/7"))


@_query("related_types", f"{EDGES} SELECT {_EDGE} FROM edges WHERE \"from\" = 'customer/7' AND type IN ('placed', 'other')")
def _(s, d):
    return _edge(graph.related(t.orders(s, d), "customer/7", ["placed", "other"], "out"))


@_query("related_as_of", f"{EDGES} SELECT {_EDGE} FROM past WHERE \"from\" = 'customer/7'")
def _(s, d):
    return _edge(graph.related(t.orders(s, d), "customer/7", direction="out", as_of="1997-01-01"))


@_query("related_page", f"{EDGES} SELECT {_EDGE} FROM edges WHERE \"from\" = 'customer/7' ORDER BY seq LIMIT 3 OFFSET 2")
def _(s, d):
    return _edge(graph.related(t.orders(s, d), "customer/7", direction="out", limit=3, offset=2))


@_query("edge_types", f"{EDGES} SELECT DISTINCT type FROM edges ORDER BY type")
def _(s, d):
    return graph.edge_types(t.orders(s, d))


def _part(c: str) -> str:
    return f"'000000' || printf('%02x', octet_length(encode({c}))) || lower(hex(encode({c})))"


_KEY = "sha256(from_hex(" + " || ".join(map(_part, ('"from"', "type", '"to"'))) + "))"


@_query("edge_keys", f'{EDGES} SELECT {_KEY} AS key, "from", type, "to" FROM edges')
def _(s, d):
    return graph.edges(t.orders(s, d)).select("key", "from", "type", "to")


SIMILAR = """
WITH points AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS key, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)) AS score FROM embeddings)"""


@_query("search_topk", f"{SIMILAR} SELECT key, round(score, 6) AS score FROM points ORDER BY points.score DESC, key LIMIT 10")
def _(s, d):
    return search.top_k(t.points(s, d), "docs", t.query_vector(s, d), 10).select("key", F.round("score", 6).alias("score"))


@_query("search", f"{SIMILAR}, best AS (SELECT * FROM points ORDER BY score DESC, key LIMIT 20) SELECT key, round(score, 6) AS score FROM best WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)")
def _(s, d):
    return search.search(t.docs(s, d), t.points(s, d), "docs", t.query_vector(s, d), limit=20).select("key", F.round("score", 6).alias("score"))


@_query("search_where", f"{SIMILAR}, best AS (SELECT * FROM points ORDER BY score DESC, key LIMIT 40) SELECT key, round(score, 6) AS score FROM best WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND lang = 'en')")
def _(s, d):
    return search.search(t.docs(s, d), t.points(s, d), "docs", t.query_vector(s, d), [("lang", "=", "en")], limit=40).select("key", F.round("score", 6).alias("score"))


@_query("search_offset", f"{SIMILAR}, best AS (SELECT * FROM points ORDER BY score DESC, key LIMIT 10 OFFSET 5) SELECT key, round(score, 6) AS score FROM best WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)")
def _(s, d):
    return search.search(t.docs(s, d), t.points(s, d), "docs", t.query_vector(s, d), limit=10, offset=5).select("key", F.round("score", 6).alias("score"))


@_query("search_offset_alone", f"{SIMILAR}, best AS (SELECT * FROM points ORDER BY score DESC, key LIMIT 7 OFFSET 3) SELECT key, round(score, 6) AS score FROM best WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)")
def _(s, d):
    return search.search(t.docs(s, d), t.points(s, d), "docs", t.query_vector(s, d), offset=3).select("key", F.round("score", 6).alias("score"))


@_query("find_bool", f"{DOCS} SELECT key FROM docs WHERE n_chars > 1000")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", [("long", "=", True)]).select("key")


@_query("find_bool_replay", f"{DOCS} SELECT key FROM docs WHERE n_chars <= 1000")
def _(s, d):
    return documents.find(t.docs(s, d), "docs", [("long", "=", False)], as_of="2024-02-01").select("key")


# through the store: written, read back, shipped, purged, restored


SNAPSHOT = "2024-01-10"


def _shipped(s: SparkSession, d: str) -> tuple[EventLog, FolderSink, str]:
    """The users' log, written in two parts with a snapshot in between, and shipped."""
    root, users = t.work_folder(s), t.users(s, d)
    log, sink = EventLog(s, f"{root}/db"), FolderSink(s, f"{root}/sink")
    early = F.col("tx_time") <= F.lit(SNAPSHOT).cast("timestamp_ntz")
    log.append(users.filter(early))
    sink.ship(log)
    sink.snapshot(log, at=parse(SNAPSHOT))
    log.append(users.filter(~early))
    sink.ship(log)
    return log, sink, root


@_query("restore_at", f"{LOG} SELECT seq, op, {ROW} FROM log WHERE tx_time <= TIMESTAMP '{AT}'")
def _(s, d):
    _, sink, root = _shipped(s, d)
    return sink.restore(f"{root}/back", AT).log().select("seq", "op", "key", "value", "valid_from", "tx_time")


@_query("restored_find", f"""{LOG} SELECT {ROW} FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM log WHERE tx_time <= TIMESTAMP '{AT}') WHERE n = 1 AND op = 'put' AND k >= 25""")
def _(s, d):
    _, sink, root = _shipped(s, d)
    sink.restore(f"{root}/back", AT)
    return _row(Database(s, f"{root}/back").find("users", [("k", ">=", 25)]))


@_query("shipped_after_purge", f"{LOG} SELECT seq, op, {ROW} FROM log WHERE tx_time >= TIMESTAMP '{CUTOFF}'")
def _(s, d):
    _, sink, _ = _shipped(s, d)
    sink.purge(CUTOFF)
    return sink.shipped().select("seq", "op", "key", "value", "valid_from", "tx_time")


@_query("last_shipped_seq", f"{LOG} SELECT max(seq) AS seq FROM log")
def _(s, d):
    _, sink, _ = _shipped(s, d)
    return retention.high_water(sink.shipped())


def _purged(s: SparkSession, d: str) -> tuple[Database, int]:
    db = Database(s, f"{t.work_folder(s)}/db")
    db.events.append(t.users(s, d))
    return db, db.purge("users", CUTOFF)


@_query("purge", f"{LOG} SELECT seq, op, {ROW}, (SELECT count(*) FROM log WHERE tx_time < TIMESTAMP '{CUTOFF}') AS purged FROM log WHERE tx_time >= TIMESTAMP '{CUTOFF}'")
def _(s, d):
    db, n = _purged(s, d)
    return db.events.log().select("seq", "op", "key", "value", "valid_from", "tx_time", F.lit(n).cast("long").alias("purged"))


@_query("find_after_purge", f"{LIVE} SELECT {ROW} FROM live WHERE k >= 25")
def _(s, d):
    return _row(_purged(s, d)[0].find("users", [("k", ">=", 25)]))


_ACCOUNTS = """
WITH accounts AS (
    SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey NOT IN (1, 2)
    UNION ALL SELECT 'new', 'NONE', 7.25)"""


def _accounts(s: SparkSession, d: str) -> Database:
    """Customers loaded in bulk, a third of them again with another balance, and some written one by one."""
    db = Database(s, f"{t.work_folder(s)}/db")
    rows = t.table(s, d, "customer").select(F.lit("accounts").alias("collection"), F.col("c_custkey").alias("key"), "c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    load = lambda df: db.events.load(df.select("collection", "key", F.to_json(F.struct("segment", "balance")).alias("value")))
    load(rows)
    db.events.keep_state(force=True)
    load(rows.filter("c_custkey % 3 = 0").withColumn("balance", F.lit(0.5)))
    db.delete("accounts", 1)
    with db.events.batch():
        db.put("accounts", "new", {"segment": "NONE", "balance": 7})
        db.put("accounts", "new", {"segment": "NONE", "balance": 7.25})
        db.delete("accounts", 2)
    return db


@_query("put_delete_find", f"{_ACCOUNTS} SELECT key FROM accounts WHERE balance > 0 AND balance < 1000")
def _(s, d):
    return _accounts(s, d).find("accounts", [("balance", ">", 0), ("balance", "<", 1000)]).select("key")


@_query("put_delete_history", """SELECT * FROM (VALUES ('1', 1, true), ('1', 2, false), ('3', 1, true), ('3', 2, true), ('new', 1, true), ('new', 2, true)) v(key, version, has_value)""")
def _(s, d):
    db = _accounts(s, d)
    rows = [db.history("accounts", k).select("key", F.col("value").isNotNull().alias("has_value"), F.monotonically_increasing_id().alias("n")) for k in ("1", "3", "new")]
    each = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return each.select("key", F.row_number().over(Window.partitionBy("key").orderBy("n")).alias("version"), "has_value")


@_query("relate_unrelate", """SELECT 'customer/' || c_custkey AS "from", 'in_nation' AS type, 'nation/' || c_nationkey AS "to", CASE WHEN c_custkey = 1 THEN '{"since": 2020}' ELSE '{}' END AS props FROM customer
    WHERE c_custkey <> 2 AND c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (1, 2))""")
def _(s, d):
    c = t.table(s, d, "customer")
    db = Database(s, f"{t.work_folder(s)}/db")
    db.events.load_edges(c.select(F.concat(F.lit("customer/"), "c_custkey").alias("from"), F.lit("in_nation").alias("type"), F.concat(F.lit("nation/"), "c_nationkey").alias("to"), F.lit("{}").alias("props")))
    home = {r.c_custkey: f"nation/{r.c_nationkey}" for r in c.filter("c_custkey in (1, 2)").select("c_custkey", "c_nationkey").collect()}
    with db.events.batch():
        db.relate("customer/1", "in_nation", home[1], {"since": 2020})
        db.unrelate("customer/2", "in_nation", home[2])
    found = [db.related(n, ["in_nation"], "in") for n in sorted(set(home.values()))]
    return reduce(DataFrame.unionByName, found).select("from", "type", "to", "props")


@_query("search_upserted", f"{SIMILAR} SELECT key, round(score, 6) AS score FROM points WHERE vec_id % 10 <> 0 AND vec_id IN (SELECT doc_id FROM documents) ORDER BY points.score DESC, key LIMIT 10")
def _(s, d):
    """Every point is written twice, the first time turned round; points without a live document aren't written."""
    store = VectorStore(s, f"{t.work_folder(s)}/vectors", 64)
    there = t.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("key"))
    rows = t.points(s, d).filter("cast(key as long) % 10 <> 0").select("key", "embedding").join(there, "key", "left_semi")
    store.upsert("docs", rows.withColumn("embedding", F.transform("embedding", lambda x: -x)))
    store.upsert("docs", rows)
    return search.search(t.docs(s, d), search.latest_points(store.points()), "docs", t.query_vector(s, d), limit=10).select("key", F.round("score", 6).alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.items() if sql}
