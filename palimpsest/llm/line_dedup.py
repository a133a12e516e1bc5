"""Removal of repeated passages by overlapping three-line windows, in column expressions alone.

Every run of three consecutive lines with text is hashed (128 bits). A window met before, in an earlier
document or further up in the same one, is a later occurrence; its three lines are covered. Windows
overlap, so a repeated passage of any length from three lines up is covered as a whole, and the covered
positions of a document are merged and taken out. Blank lines are no part of windows and stay.

Windows are counted by partial aggregation, so a passage that stands in a third of all documents meets
in one small row per task. Windows that stand once go no further. The rest are joined back in SALTS
parts, as one window may be in very many documents; texts are shuffled once, to meet the positions to
take out. Both joins are sort-merge joins at any size, so needs grow in proportion to the input.

Defined results: a document is its id and its text, so rows that repeat both are one document and get
the same text; the earliest is that of the smallest id (null first), then of the smallest hash of the
text, then the smallest position. Lines are compared without the white space around them. A null
text stays null; texts of fewer than three lines with text stay as they are; a text of which all
is covered becomes empty. All columns and rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table

WINDOW = 3
#: White space that doesn't count at the ends of a line.
BLANK = " \t\r\x0b\x0c"
SALTS = 16


def _once(c: Column) -> Column:
    """A generator of one row: what stands above it reads the value, and doesn't compute it anew for
    each element of an array."""
    return F.explode(F.array(c))


def _solid(text: Column) -> Column:
    """array<struct<i, h1, h2>>: position and two hashes of each line that isn't blank."""
    bare = lambda x: F.btrim(x, F.lit(BLANK))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), bare(x).alias("t")))
    solid = F.filter(lines, lambda x: F.length(x["t"]) > 0)
    return F.transform(solid, lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["t"]).alias("h1"), F.xxhash64(F.lit(WINDOW), x["t"]).alias("h2")))


def _windows(solid: Column) -> Column:
    """array<struct<at, w1, w2>>: the lines' positions and the hash of each window."""
    n = F.size(solid) - F.lit(WINDOW - 1)
    parts = [F.slice(solid, F.lit(k + 1), n).alias(f"l{k}") for k in range(WINDOW)]
    pick = lambda w, f: [w[f"l{k}"][f] for k in range(WINDOW)]
    one = lambda w: F.struct(F.array(*pick(w, "i")).alias("at"), F.xxhash64(*pick(w, "h1")).alias("w1"), F.xxhash64(*pick(w, "h2")).alias("w2"))
    return F.when(n > 0, F.transform(F.arrays_zip(*parts), one))


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h, gone): by document, the positions of the lines that repeat earlier ones."""
    spark = docs.sparkSession
    solid = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("h"), _once(_solid(F.col(text))).alias("solid"))
    rows = solid.select("doc", "h", F.explode(_windows(F.col("solid"))).alias("w")).select("doc", "h", F.col("w.at").alias("at"), F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"))
    rows = materialize(spark, rows, "windows")
    place = F.struct(F.col("doc"), F.col("h"), F.col("at")[0].alias("i"))
    seen = rows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    seen = materialize(spark, seen.filter(~F.col("first").eqNullSafe(F.col("last"))).select("w1", "w2", "first"), "repeats")
    parts = seen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "h", F.col("at")[0]), F.lit(SALTS)).cast("int"))
    later = salted.join(parts.hint("merge"), ["w1", "w2", "salt"]).filter(~place.eqNullSafe(F.col("first")))
    # windows overlap: each position is met up to WINDOW times
    return later.groupBy("doc", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("gone"))


def _left(lines: Column, gone: Column) -> Column:
    """The lines but those at the positions ``gone``, as text."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - F.lit(1)), gone)
    return F.array_join(F.transform(kept, lambda p: F.element_at(lines, p + F.lit(1))), "\n")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines that repeat earlier passages taken out of ``text``."""
    gone = materialize(docs.sparkSession, covered(docs, doc_id, text), "covered")
    d, h, g, s = fresh(docs, "__doc", "__hash", "__gone", "__lines")
    gone = gone.select(F.col("doc").alias(d), F.col("h").alias(h), F.col("gone").alias(g))
    joined = docs.join(gone.hint("merge"), F.col(doc_id).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(h)), "left")
    joined = joined.select(*docs.columns, g, _once(F.when(F.col(g).isNotNull(), F.split(F.col(text), "\n"))).alias(s))
    left = F.when(F.col(g).isNull(), F.col(text)).otherwise(_left(F.col(s), F.col(g)))
    return joined.select(*[left.alias(c) if c == text else F.col(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (positions, joined by commas), text_md5 of every document."""
    cut = materialize(docs.sparkSession, covered(docs), "covered").select(F.col("doc").alias("d"), "h", "gone")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(cut.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h")), "left")
    rows = rows.select("doc_id", "text", "gone", _once(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))
    left = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(_left(F.col("lines"), F.col("gone")))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"), F.md5(left.cast("binary")).alias("text_md5"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs)


#: Documents with an id each, as the table has them.
SQL = """
WITH lines AS (
    SELECT doc_id, i - 1 AS i, trim(part[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t
    FROM (SELECT doc_id, string_split(text, chr(10)) AS part, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
), solid AS (
    SELECT doc_id, i AS i0, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2, t AS t0, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2
    FROM lines WHERE length(t) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY t0, t1, t2 ORDER BY doc_id NULLS FIRST, i0) AS k FROM solid WHERE i2 IS NOT NULL
), gone AS (
    SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM ranked WHERE k > 1
), cut AS (
    SELECT doc_id, list(i ORDER BY i) AS gone FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines,
    CAST(coalesce(len(c.gone), 0) AS BIGINT) AS n_removed,
    coalesce(array_to_string(c.gone, ','), '') AS removed,
    md5(CASE WHEN c.gone IS NULL THEN coalesce(d.text, '')
        ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, n: NOT list_contains(c.gone, n - 1)), chr(10)) END) AS text_md5
FROM documents d LEFT JOIN cut c ON d.doc_id IS NOT DISTINCT FROM c.doc_id
"""
