"""Sharding by jump consistent hashing, in column expressions alone.

The shard of a row depends on its key and on the number of shards, without a table of the ring: a
pseudo-random sequence seeded by the key tells at which counts of shards the key would move, and the
last such count below the number of shards names its shard. Appending a shard moves just the keys whose
next move falls on it, 1/(n+1) of all, and none between old shards.

Rows get a gapless slot in their shard from counts of the 1024 cells of each shard (a table of bounded
size) and a rank in the cell, so no task sees a whole shard. The cell comes from id and text, so the rows of one
id are dealt over all cells; rows that repeat both share one.

Defined results: a null text has size 1 and the crc of no bytes; a null id counts as id 0; repeated rows share a
shard and take slots one after another (ties by id, crc and size are interchangeable); an empty table gives no
rows; other columns pass through ``assign`` and ``slots``, also those named like the ones in between; a key that
isn't through after the bounded number of jumps is an error, never a row without a shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table

SHARDS = 16
CELLS = 1024
#: Fixed values of the published algorithm: the multiplier of its generator.
MULTIPLIER = 2862933555777941757


def _times(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2^64, from limbs of 22, 22 and 20 bits: no product overflows."""
    mask, top = (1 << 22) - 1, (1 << 20) - 1
    m0, m1, m2 = MULTIPLIER & mask, MULTIPLIER >> 22 & mask, MULTIPLIER >> 44
    k0 = key.bitwiseAND(F.lit(mask))
    k1 = F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(mask))
    k2 = F.shiftrightunsigned(key, 44)
    low = k0 * F.lit(m0) + F.lit(1)
    mid = k0 * F.lit(m1) + k1 * F.lit(m0) + F.shiftright(low, 22)
    high = k0 * F.lit(m2) + k1 * F.lit(m1) + k2 * F.lit(m0) + F.shiftright(mid, 22)
    return low.bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(mid.bitwiseAND(F.lit(mask)), 22)).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(top)), 44))


def jump(key: Column, shards: int) -> Column:
    """struct(b, j): the shard ``b`` among ``shards``, and the next count at which the key moves."""
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    # A key jumps ln(shards) + 0.6 times on average, as independent events do; so many never come.
    steps = min(shards, 60 + 12 * math.ceil(math.log(shards)))
    start = F.struct(key.alias("key"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(at: Column, _: Column) -> Column:
        after = _times(at["key"])
        share = F.lit(float(1 << 31)) / (F.shiftrightunsigned(after, 33) + F.lit(1)).cast("double")
        moved = F.struct(after.alias("key"), at["j"].alias("b"), F.floor((at["j"] + F.lit(1)).cast("double") * share).cast("long").alias("j"))
        return F.when(at["j"] < F.lit(shards), moved).otherwise(at)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), start, step)
    through = F.struct(end["b"].alias("b"), end["j"].alias("j"))
    return through if steps == shards else F.when(end["j"] >= F.lit(shards), through).otherwise(F.raise_error(F.lit("a key has more jumps than expected")).cast("struct<b:bigint,j:bigint>"))


def assign(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Adds the shard of each row and the one it has when one more is appended."""
    (at,) = fresh(df, "__jump")
    found = df.withColumn(at, jump(F.coalesce(F.col(key).cast("long"), F.lit(0)), shards))
    # a key moves to the appended shard when its next move falls on it
    return found.withColumns({shard: F.col(at)["b"].cast("int"), grown: F.when(F.col(at)["j"] == F.lit(shards), F.lit(shards)).otherwise(F.col(at)["b"]).cast("int")}).drop(at)


def slots(df: DataFrame, order: list[str], shard: str = "shard", cell: str = "cell", slot: str = "slot") -> DataFrame:
    """Adds a gapless slot per shard: the rows in the cells before, and the rank in the cell."""
    n, s, c, b, r = fresh(df, "__n", "__s", "__c", "__before", "__rank")
    counts = df.groupBy(shard, cell).agg(F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy(shard).orderBy(F.col(cell).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(shard).alias(s), F.col(cell).alias(c), F.coalesce(before, F.lit(0)).alias(b))
    rank = F.row_number().over(Window.partitionBy(shard, cell).orderBy(*[F.col(x).asc_nulls_first() for x in order]))
    ranked = df.withColumn(r, rank)
    # at most shards x CELLS rows
    joined = ranked.join(F.broadcast(offsets), F.col(shard).eqNullSafe(F.col(s)) & F.col(cell).eqNullSafe(F.col(c)))
    return joined.withColumn(slot, F.col(b) + F.col(r) - F.lit(1)).drop(s, c, b, r)


def cell_of(doc_id: Column, crc: Column) -> Column:
    """A cell from id and checksum by two steps of the same generator."""
    seed = F.coalesce(doc_id.cast("long"), F.lit(0)).bitwiseXOR(F.shiftleft(crc, 31))
    return F.shiftrightunsigned(_times(_times(seed)), 44).bitwiseAND(F.lit(CELLS - 1)).cast("int")


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign(rows, shards=shards).withColumn("cell", cell_of(F.col("doc_id"), F.col("text_crc32")))
    return slots(rows, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"))


#: The same rows: CRC-32 by its table of 256 remainders, jumps in integers of 128 bits. 3988292384 is the reversed
#: polynomial; 17 jumps are as many as 16 shards can take.
SQL = """
WITH texts AS (
    SELECT CAST(doc_id AS BIGINT) AS doc_id, COALESCE("text", '') AS t, regexp_extract_all(hex(encode(COALESCE("text", ''))), '..') AS pairs
    FROM documents
), crc_table AS (
    SELECT list(v ORDER BY i) AS crcs
    FROM (
        SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS i)
    )
), rows AS (
    SELECT doc_id, len(pairs) + 1 AS size,
           xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(pairs, lambda p: CAST('0x' || p AS BIGINT))),
                           lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM texts, crc_table
), jumped AS (
    SELECT *,
           list_reduce(
               list_prepend({'key': CAST(CAST(COALESCE(doc_id, 0) AS HUGEINT) + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END AS HUGEINT), 'b': CAST(-1 AS BIGINT), 'j': CAST(0 AS BIGINT)},
                            list_transform(range(17), lambda i: {'key': CAST(0 AS HUGEINT), 'b': CAST(0 AS BIGINT), 'j': CAST(0 AS BIGINT)})),
               lambda s, x: CASE WHEN s.j >= 16 THEN s ELSE {
                   'key': (s.key * 2862933555777941757 + 1) % 18446744073709551616,
                   'b': s.j,
                   'j': CAST(floor(CAST(s.j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / CAST(((s.key * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1 AS DOUBLE))) AS BIGINT)} END) AS jump,
           xor(CAST(COALESCE(doc_id, 0) AS HUGEINT) + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END, (CAST(text_crc32 AS HUGEINT) * 2147483648) % 18446744073709551616) AS seed
    FROM rows
), placed AS (
    SELECT *, CAST(jump.b AS INTEGER) AS shard, CAST(CASE WHEN jump.j = 16 THEN 16 ELSE jump.b END AS INTEGER) AS grown_shard,
           ((((seed * 2862933555777941757 + 1) % 18446744073709551616) * 2862933555777941757 + 1) % 18446744073709551616) // 17592186044416 % 1024 AS cell
    FROM jumped
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard
FROM placed
"""
