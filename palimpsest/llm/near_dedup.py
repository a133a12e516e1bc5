"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles: weight = count in the document x inverse
document frequency. The latter is counted over all documents in a sketch of fixed size (two rows of
2^20 counters, the smaller one counts), so it needs no shuffle of shingles. It is 1 for shingles in at most
1 % of documents and falls with the logarithm of the frequency to a half for those in all: a passage
that everyone quotes counts less, while copies, which share what is rare elsewhere, count in full.

Improved consistent weighted sampling draws from each set SAMPLES shingles such that two sets draw the
same with the probability of their weighted Jaccard similarity. Samples are put into bands of ROWS;
documents that agree in a band are candidates, and a candidate pair counts if the exact weighted
Jaccard similarity of the two sets is at least the threshold.

Groups may hold a third of all rows, so no step emits the pairs of a group, and what is known of a bucket
meets its members in parts of PART_ROWS or so:

1. Exact copies (same text) become one document, the smallest id.
2. In each bucket of a band, every member is compared with one, its leader: as many pairs as members. It
   leads who stands in the largest buckets, as a text does that the others were made from.
3. Links join documents into components, by repeated grouping in tables.
4. In large buckets that hold several components still, the best placed member outside the main one is
   compared with all members of other components, a few rounds over.
5. What is left are pairs of one bucket whose components differ and of which one isn't in the bucket's
   main component. They may still be links, if two bounds allow it. 1 - weighted Jaccard is a metric, so
   their distances to the leader differ by no more than 1 - threshold. And two sets have no more in
   common than the leader's without what either lacks, and what both have beyond the leader's. All
   pairs within both bounds are compared; edited copies of one text are not, unless their edits agree.

Defined results: a text without words is in a class with its exact copies alone; a text of fewer than five
words has one shingle, all its words; null counts as a text of its own kind (nulls are copies of one
another); documents are known by id, rows that repeat an id and its text are one member of the class
each, and all get the same class. The class id is the smallest document id in the class (null sorts
first and gives a null class id only if all ids in the class are null). An empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, fresh, latest, materialize, once, slim, table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
SAMPLES = BANDS * ROWS
#: The sketch of document frequencies; a share of documents above which weights fall, and where to.
CELLS_LOG2, CHUNKS = 20, 64
COMMON, FLOOR = 0.01, 0.5
#: Groups of a leader's shingles in which others tell what they lack.
GROUPS = 64
#: Members of a bucket that one task meets, or so: larger buckets are dealt in parts.
PART_ROWS = 64
#: Members up to which a bucket needs no pivots, and rounds of pivots in larger ones.
SMALL, PIVOT_ROUNDS = 16, 2
_DRAWS_LOG2 = 20
_SEP = bytes(0 if chr(i).isalnum() or i >= 128 else 1 for i in range(256))
#: Spaces and punctuation beyond ASCII; letters and digits of all scripts are parts of words.
_WIDE_SPACE = re.compile("[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\u2000-\u206f\u3000-\u3004\u3008-\u3020\uff01-\uff0f]")


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Tables of pseudo-random draws, the same in every process."""

    def __init__(self):
        import numpy as np

        rng = np.random.Generator(np.random.PCG64(20240229))
        n = 1 << _DRAWS_LOG2
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = rng.random(n, dtype=np.float32)
        # for weight 1: log a = log c - r + r * beta
        self.unit = self.log_c - self.r * (0 - self.beta) - self.r
        self.odd = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
        self.bytes = rng.integers(0, 1 << 63, 256, dtype=np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        self.sep = np.frombuffer(_SEP, np.uint8).astype(bool)
        self.order = rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _powers(self, n: int):
        import numpy as np

        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                self.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, self.base, np.uint64)]))
                self.inverses = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, self.inverse, np.uint64)]))
        return self.powers, self.inverses

    def shingles(self, text: str | None):
        """(64-bit hashes of distinct shingles, ascending; their counts). Words are runs of letters,
        digits and other characters beyond ASCII, in lower case."""
        import numpy as np

        low = (text or "").lower()
        if not low.isascii():
            low = _WIDE_SPACE.sub(" ", low)
        raw = np.frombuffer(low.encode(), np.uint8)
        if not len(raw):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        word = ~self.sep[raw]
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        powers, inverses = self._powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.bytes[raw] * powers[: len(raw)])])
            words = _mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
            k = min(SHINGLE, len(words))
            n = len(words) - k + 1
            h = np.full(n, k, np.uint64)
            for i in range(k):
                h = _mix(h * self.order[i] + words[i : i + n])
        return np.unique(h, return_counts=True)

    def cells(self, h):
        """Places of hashes in the two rows of the sketch."""
        import numpy as np

        mask = np.uint64((1 << CELLS_LOG2) - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(CELLS_LOG2)) & mask).astype(np.int64)

    def weights(self, h, counts, idf):
        import numpy as np

        if idf is None:
            return counts.astype(np.float64)
        a, b = self.cells(h)
        return counts * np.maximum(idf[0][a], idf[1][b]).astype(np.float64)

    def sample(self, h, w):
        """SAMPLES 64-bit names of drawn (shingle, level) pairs."""
        import numpy as np

        plain = w == 1.0
        best = np.full(SAMPLES, np.inf)
        name = np.zeros(SAMPLES, np.uint64)
        shift = np.uint64(64 - _DRAWS_LOG2)
        with np.errstate(over="ignore"):
            for part in _parts(h[plain]):
                idx = ((self.odd[:, None] * part[None, :]) >> shift).view(np.int64)
                a = np.take(self.unit, idx, mode="wrap")
                at = a.argmin(axis=1)
                low = a[np.arange(SAMPLES), at].astype(np.float64)
                better = low < best
                best[better] = low[better]
                name[better] = _mix(part[at[better]])
            for part, lw in zip(_parts(h[~plain]), _parts(np.log(w[~plain])), strict=True):
                idx = ((self.odd[:, None] * part[None, :]) >> shift).view(np.int64)
                r = self.r[idx]
                t = np.floor(lw[None, :].astype(np.float32) / r + self.beta[idx])
                # log a = log c - log y - r, and log y = r (t - beta)
                a = self.log_c[idx] - r * (t - self.beta[idx]) - r
                at = a.argmin(axis=1)
                rows = np.arange(SAMPLES)
                low = a[rows, at].astype(np.float64)
                better = low < best
                best[better] = low[better]
                levels = t[rows, at].astype(np.int64).view(np.uint64)
                name[better] = _mix(_mix(part[at[better]]) + levels[better] * self.order[0]) if better.any() else name[better]
                # level 0 is what weight 1 draws
                zero = better & (levels == 0)
                name[zero] = _mix(part[at[zero]])
        return name

    def bands(self, name):
        """A 64-bit hash for each band."""
        import numpy as np

        with np.errstate(over="ignore"):
            b = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
            for i in range(ROWS):
                b = _mix(b * self.order[i] + name.reshape(BANDS, ROWS)[:, i])
        return b.view(np.int64)


def _parts(x, n: int = 4096):
    return [x[i : i + n] for i in range(0, len(x), n)]


def sampler() -> Sampler:
    return once("near_dedup", "icws", Sampler)


def document_frequencies(docs: DataFrame):
    """(2 x 2^20 inverse document frequencies as float32 bytes, number of documents). Tasks count in
    sketches of their own; chunks of these are added up in three rounds of 256 at a time."""
    import numpy as np

    cells = 1 << CELLS_LOG2
    size = 2 * cells // CHUNKS

    def count(batches):
        import zlib

        import pyarrow as pa

        s, seen, n = sampler(), np.zeros((2, cells), np.int32), 0
        for b in slim(batches):
            for text in b["text"].to_pylist():
                h, _ = s.shingles(text)
                for row, at in zip(seen, s.cells(h), strict=True):
                    row += np.bincount(at, minlength=cells).astype(np.int32) if len(at) > cells // 8 else 0
                    if len(at) <= cells // 8:
                        np.add.at(row, at, 1)
                n += 1
        if n:
            flat = seen.reshape(-1)
            parts = [zlib.compress(flat[i : i + size].tobytes(), 1) for i in range(0, len(flat), size)]
            from pyspark import TaskContext

            yield pa.RecordBatch.from_pydict({"chunk": pa.array([*range(CHUNKS), -1], pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * (CHUNKS + 1), pa.int32()), "counts": pa.array([*parts, str(n).encode()], pa.binary())})

    def add(key, rows):
        import zlib

        import pyarrow as pa

        (chunk, part), parts = (k.as_py() for k in key), rows.column("counts").to_pylist()
        if chunk < 0:
            out = str(sum(map(int, parts))).encode()
        else:
            total = np.zeros(size, np.int64)
            for x in parts:
                raw = zlib.decompress(x)
                total += np.frombuffer(raw, np.int32 if len(raw) == 4 * size else np.int64)
            out = zlib.compress(total.tobytes(), 1)
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "part": pa.array([part], pa.int32()), "counts": pa.array([out], pa.binary())})

    counts = docs.select("text").mapInArrow(count, "chunk int, part int, counts binary")
    for _ in range(3):  # 2^24 tasks and one
        counts = counts.withColumn("part", F.shiftright("part", 8)).groupBy("chunk", "part").applyInArrow(add, "chunk int, part int, counts binary")
    rows = counts.collect()  # of fixed size
    import zlib

    n = next((int(r.counts) for r in rows if r.chunk < 0), 0)
    if not n:
        return b"", 0
    flat = np.concatenate([np.frombuffer(zlib.decompress(r.counts), np.int64) for r in sorted(rows, key=lambda r: r.chunk) if r.chunk >= 0])
    return idf_of(flat, n).astype(np.float32).tobytes(), n


def idf_of(df, n: int):
    """1 up to a share of COMMON, then falling with the logarithm to FLOOR for all of ``n`` documents."""
    import numpy as np

    share = np.maximum(df / max(n, 1), COMMON)
    return FLOOR + (1 - FLOOR) * np.clip(np.log(share) / np.log(COMMON), 0, 1)


def _idf(data: bytes, key: str):
    import numpy as np

    return latest("near_dedup", "idf", key, lambda: np.frombuffer(data, np.float32).reshape(2, -1)) if data else None


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two packed sets."""
    import numpy as np

    (ha, wa), (hb, wb) = _unpack(a), _unpack(b)
    if not len(ha) or not len(hb):
        return 0.0
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    same = hb[at] == ha
    both = np.minimum(wa[same], wb[at[same]]).sum()
    return float(both / (wa.sum() + wb.sum() - both))


def _pack(h, w) -> bytes:
    """Upper halves of the hashes, ascending, and the weights that aren't 1 with their places. Half a
    hash confuses two of a pair's shingles once in 4e9 comparisons."""
    import numpy as np

    other = np.flatnonzero(w != 1.0)
    return np.array([len(h)], np.uint32).tobytes() + (h >> np.uint64(32)).astype(np.uint32).tobytes() + other.astype(np.uint32).tobytes() + w[other].astype(np.float32).tobytes()


def _unpack(x: bytes):
    import numpy as np

    n = int(np.frombuffer(x, np.uint32, 1)[0])
    m = (len(x) - 4 - 4 * n) // 8
    w = np.ones(n)
    w[np.frombuffer(x, np.uint32, m, 4 + 4 * n)] = np.frombuffer(x, np.float32, m, 4 + 4 * n + 4 * m)
    return np.frombuffer(x, np.uint32, n, 4), w


def _digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.col(text)
    key = F.coalesce(F.concat(F.lit("t"), F.md5(t.cast("binary")), F.hex(F.xxhash64(t))), F.lit("null"))
    return docs.select(F.col(doc_id).cast("long").alias("id"), key.alias("digest"))


def _verified(spark: SparkSession, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(a, b, sim) of the pairs (a, b). One ``a`` may have very many pairs: both joins are plain
    sort-merge joins, whose large partitions Spark splits while the query runs."""
    pairs = materialize(spark, pairs.distinct(), f"{name}-pairs")
    met = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")

    def run(b):
        return {"a": b["a"], "b": b["b"], "sim": [similarity(x, y) for x, y in zip(b["set_a"].to_pylist(), b["set_b"].to_pylist(), strict=True)]}

    return materialize(spark, arrow_rows(met.select("a", "b", "set_a", "set_b"), run, "a long, b long, sim double"), f"{name}-verified")


def components(spark: SparkSession, links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b): the smallest node each can reach.

    In alternating rounds, whatever the size: every node's larger neighbours are linked to its smallest
    neighbour, then its smaller ones are. Each round is written to a table, and links with the smallest node of
    a group of many are made by aggregation and a join that Spark may split, so hubs are no bottleneck."""
    edges = materialize(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), name)
    for turn in range(64):
        # large-star: neighbours above u meet the smallest of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(spark, large.distinct(), f"{name}-large")
        # small-star: neighbours below u, and u itself, meet the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v")
        edges = materialize(spark, small.distinct(), f"{name}-{turn}")
        # stars alone are left when each node is below one other at most, and none of these is below another
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("top")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("top")))
        if not ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("top").alias("top")).filter("below + top > 1").limit(1).count():
            tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
    raise RuntimeError("components did not settle in 64 rounds")


def _joined(spark: SparkSession, comp: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """``comp`` (node, component) after ``more`` links: what is known is a star a component, which settles fast."""
    known = comp.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(spark, known.unionByName(more.select("a", "b")), name) if more.limit(1).count() else comp


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has digest, node (smallest id of the same text), n (rows of that
    text), component (smallest node of the class); links has a, b, sim between different texts."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    ids = _digests(docs, doc_id, text).groupBy("digest", "id").agg(F.count("*").alias("rows"))
    first = F.min(F.struct("id", "rows"))
    groups = ids.groupBy("digest").agg(first["id"].alias("node"), first["rows"].alias("first_rows"), F.sum("rows").alias("n"), F.max(F.xxhash64("digest")).alias("mark"))
    groups = materialize(spark, groups, "texts")
    idf, n = document_frequencies(narrow)
    given = spark.sparkContext.broadcast(idf)  # 8 MB
    mark = uuid.uuid4().hex

    def sign(batches):
        import pyarrow as pa

        s, w = sampler(), _idf(given.value, mark)
        for b in slim(batches):
            nodes, bands = [], []
            for i, t in zip(b["key"].to_pylist(), b["text"].to_pylist(), strict=True):
                h, c = s.shingles(t)
                if len(h):
                    nodes.append(i)
                    bands.append(s.bands(s.sample(h, s.weights(h, c, w))))
            if nodes:
                flat = pa.array([x for y in bands for x in y], pa.int64())
                yield pa.RecordBatch.from_pydict({"key": pa.array(nodes, pa.int64()), "bands": pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, BANDS), pa.int32()), flat)})

    # a text is known by a 64-bit key besides its digest; the rows of one text give the same bands
    keyed = narrow.select(text_key(F.col("text")).alias("key"), "text")
    signed = keyed.mapInArrow(sign, "key long, bands array<bigint>")
    buckets = materialize(spark, signed.select("key", F.explode("bands").alias("bucket")).distinct(), "buckets")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1")
    # large buckets are dealt in parts from here on; this one join is a sort-merge join, which Spark splits
    held = materialize(spark, _in_parts(buckets.join(shared.hint("merge"), "bucket")), "held")
    # a text that others were made from stands in the largest buckets: it leads
    met_by = held.groupBy("key").agg(F.sum("k").alias("score"))
    scored = materialize(spark, held.join(met_by, "key"), "scored")
    lead = materialize(spark, scored.groupBy("bucket").agg(F.max_by("key", F.struct("score", "key")).alias("a"), F.max("parts").alias("parts")), "leads")
    members = materialize(spark, _meet(scored, lead), "candidates")
    pairs = members.filter("key != a").select("a", F.col("key").alias("b"))

    # the sets of candidates alone, each made from one row
    wanted = members.select("key").distinct().join(groups.select(F.col("mark").alias("key"), "node", "first_rows"), "key")
    wanted = materialize(spark, wanted, "wanted")

    def pack(batches):
        import pyarrow as pa

        s, w = sampler(), _idf(given.value, mark)
        for b in slim(batches):
            out = [_pack(h, s.weights(h, c, w)) for h, c in map(s.shingles, b["text"].to_pylist())]
            yield pa.RecordBatch.from_pydict({"node": b["key"], "set": pa.array(out, pa.binary())})

    some = narrow.select(text_key(F.col("text")).alias("k"), "id", "text")
    # a sort-merge join at any size: needs grow in proportion to the input
    chosen = some.join(wanted.hint("merge"), (F.col("k") == F.col("key")) & F.col("id").eqNullSafe(F.col("node"))).select("key", "text", "first_rows")
    if wanted.filter("first_rows > 1").limit(1).count():
        chosen = chosen.filter("first_rows = 1").unionByName(chosen.filter("first_rows > 1").groupBy("key").agg(F.any_value("text").alias("text"), F.max("first_rows").alias("first_rows")))
    chosen = chosen.select("key", "text")
    sets = materialize(spark, chosen.mapInArrow(pack, "node long, set binary"), "sets")
    met = _verified(spark, pairs, sets, "leader")
    links = met.filter(F.col("sim") >= F.lit(threshold))
    comp = components(spark, links)

    # large buckets of several components: pivots drawn anew each round are compared with the others
    for turn in range(PIVOT_ROUNDS):
        state = _state(spark, members.filter(F.col("k") > F.lit(SMALL)), comp, f"state-{turn}")
        outside = materialize(spark, _meet(state, _main(state)).filter("c != main"), f"outside-{turn}")
        pivot = outside.groupBy("bucket").agg(F.max_by(F.struct("key", "c"), F.struct("score", "key")).alias("p"), F.max("parts").alias("parts")).select("bucket", "parts", F.col("p.key").alias("a"), F.col("p.c").alias("ca"))
        pivot = materialize(spark, pivot, f"pivots-{turn}")
        if not pivot.limit(1).count():
            break
        others = _meet(state.drop("a", "score"), pivot).filter(F.col("c") != F.col("ca")).select("a", F.col("key").alias("b"))
        more = _verified(spark, others, sets, f"pivot-{turn}").filter(F.col("sim") >= F.lit(threshold))
        links = links.unionByName(more)
        comp = _joined(spark, comp, more, f"components-{turn}")

    # what leaders and pivots don't tell: members of one bucket that are still in different components
    state = _state(spark, members, comp, "state")
    far = met.select("a", F.col("b").alias("key"), (F.lit(1.0) - F.col("sim")).alias("d"))
    state = _meet(state, _main(state)).join(far, ["a", "key"])
    about = _against_leader(spark, state.select("a", "key").distinct(), sets)
    state = state.join(about, ["a", "key"])
    state = materialize(spark, state.select("bucket", "part", "parts", "key", "c", "d", "t", "low", "lacks", "more", (F.col("c") == F.col("main")).alias("is_main")), "mixed")
    # a link has so much in common; two texts have no more than the leader's weight without what either
    # lacks, and what both have beyond it
    enough = F.lit(threshold / (1 + threshold) - 1e-6)
    sum_of = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    least = state.groupBy("bucket").agg(F.min("t").alias("t_min"), F.max("parts").alias("parts"))
    few = _meet(state.filter("not is_main"), least).filter(F.col("low") - sum_of(F.col("lacks")) + F.col("more") >= enough * (F.col("t") + F.col("t_min")))
    few = few.select("bucket", "parts", F.col("key").alias("x"), F.col("c").alias("cx"), F.col("d").alias("dx"), F.col("t").alias("tx"), F.col("lacks").alias("lx"), F.col("more").alias("mx"))
    common = F.col("low") - sum_of(F.zip_with("lx", "lacks", lambda u, v: F.greatest(u, v))) + F.least("mx", "more")
    near = (F.abs(F.col("dx") - F.col("d")) <= F.lit(1 - threshold + 1e-6)) & (common >= enough * (F.col("tx") + F.col("t")))
    # the few meet every part of their bucket
    rest = _meet(state, few).filter(near & (F.col("cx") != F.col("c")) & (F.col("is_main") | (F.col("x") < F.col("key"))))
    rest = materialize(spark, rest.select(F.least("x", "key").alias("a"), F.greatest("x", "key").alias("b")).distinct(), "rest")
    if rest.limit(1).count():
        more = _verified(spark, rest, sets, "rest").filter(F.col("sim") >= F.lit(threshold))
        links = links.unionByName(more)
        comp = _joined(spark, comp, more, "again")

    known = groups.select(F.col("mark"), "digest", "node", "n")
    found = known.join(comp.select(F.col("node").alias("mark"), "component"), "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    return materialize(spark, found, "classes"), links


def _in_parts(members: DataFrame) -> DataFrame:
    """Adds to members (bucket, key, k) the number of parts of their bucket, and the part each is in."""
    parts = F.ceil(F.col("k") / F.lit(PART_ROWS)).cast("int")
    return members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))


def _meet(members: DataFrame, about: DataFrame) -> DataFrame:
    """Members (bucket, part) with the rows ``about`` (bucket, parts) their bucket, which go to all its parts: no
    task holds more of a bucket than a part of it."""
    spread = about.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - F.lit(1)))).drop("parts")
    return members.join(spread, ["bucket", "part"])


def _main(state: DataFrame) -> DataFrame:
    """(bucket, parts, main): the component with the most members."""
    each = state.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.max("parts").alias("parts"))
    return each.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("parts").alias("parts"))


def _against_leader(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, key, t, low, lacks, more) of the pairs (a, key): the weight of key's set and of the leader's; what
    key's lacks of the leader's, in GROUPS groups of shingles; and the weight it has beyond the leader's, but
    for what no other set of the leader's has. As many rows are shuffled as shingles are new to the leader."""
    met = pairs.join(sets.select(F.col("node").alias("key"), F.col("set").alias("set_b")), "key").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")

    def run(b):
        import numpy as np

        out: dict[str, list] = {k: [] for k in ("t", "low", "lacks", "more", "h", "w")}
        for x, y in zip(b["set_a"].to_pylist(), b["set_b"].to_pylist(), strict=True):
            (ha, wa), (hb, wb) = _unpack(x), _unpack(y)
            at = np.minimum(np.searchsorted(hb, ha), max(0, len(hb) - 1))
            there = np.where(hb[at] == ha, wb[at], 0.0) if len(hb) else np.zeros(len(ha))
            new = ~np.isin(hb, ha)
            out["t"].append(float(wb.sum()))
            out["low"].append(float(wa.sum()))
            out["lacks"].append(np.bincount(ha % GROUPS, weights=np.maximum(0.0, wa - there), minlength=GROUPS).tolist())
            out["more"].append(float(wb[new].sum() + np.maximum(0.0, there - wa).sum()))
            out["h"].append(hb[new].astype(np.int64).tolist())
            out["w"].append(wb[new].tolist())
        return {"a": b["a"], "key": b["key"]} | out

    new = materialize(spark, arrow_rows(met.select("a", "key", "set_a", "set_b"), run, "a long, key long, t double, low double, lacks array<double>, more double, h array<bigint>, w array<double>"), "new")
    each = new.select("a", "key", F.explode(F.arrays_zip("h", "w")).alias("e")).select("a", "key", F.col("e.h").alias("h"), F.col("e.w").alias("w"))
    alone = each.groupBy("a", "h").agg(F.count("*").alias("n"), F.max("key").alias("key"), F.max("w").alias("w")).filter("n = 1")
    alone = alone.groupBy("a", "key").agg(F.sum("w").alias("alone"))
    return new.select("a", "key", "t", "low", "lacks", "more").join(alone, ["a", "key"], "left").select("a", "key", "t", "low", "lacks", (F.col("more") - F.coalesce("alone", F.lit(0.0))).alias("more"))


def _state(spark: SparkSession, members: DataFrame, comp: DataFrame, name: str) -> DataFrame:
    """(bucket, part, parts, key, a, score, c): the members, with their components, of buckets that hold several."""
    now = members.join(comp.withColumnRenamed("node", "key"), "key", "left").select("bucket", "part", "parts", "key", "a", "score", F.coalesce("component", "key").alias("c"))
    now = materialize(spark, now, f"{name}-all")
    mixed = now.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("parts").alias("parts")).filter("low != high").select("bucket", "parts")
    return materialize(spark, _meet(now, mixed), name)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("t"), F.md5(text.cast("binary")), F.hex(F.xxhash64(text))), F.lit("null")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links (documents linked to its text directly, as found; its copies
    included), class_size, kept of every document."""
    docs = table(spark, sf_dir, "documents")
    return label(docs)


def label(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    found, links = classes(docs)
    ids = found.groupBy("component").agg(F.min("node").alias("class_id"), F.sum("n").alias("class_size"))
    ids = materialize(spark, ids, "class-ids")
    ends = links.select(F.col("a").alias("mark"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("mark"), F.col("a").alias("other"))).distinct()
    degree = ends.join(found.select(F.col("mark").alias("other"), "n"), "other").groupBy("mark").agg(F.sum("n").alias("linked"))
    by_text = found.join(ids, "component").join(degree, "mark", "left").select("digest", "n", "class_id", "class_size", F.coalesce("linked", F.lit(0)).alias("linked"))
    by_text = materialize(spark, by_text, "by-text")
    # the rows of a text of many are dealt over parts
    hot = by_text.filter("n > 64").select(F.col("digest").alias("dh"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part_of"), *[F.col(c).alias(f"hot_{c}") for c in ("n", "class_id", "class_size", "linked")])
    hot = materialize(spark, hot, "hot-texts")
    rows = _digests(docs, "doc_id", "text").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
    rows = rows.join(hot, (F.col("digest") == F.col("dh")) & (F.col("part") == F.col("part_of")), "left")
    hot_rows = rows.filter("dh is not null").select("id", *[F.col(f"hot_{c}").alias(c) for c in ("n", "class_id", "class_size", "linked")])
    cold_rows = rows.filter("dh is null").select("id", "digest").join(by_text.filter("n <= 64"), "digest").select("id", "n", "class_id", "class_size", "linked")
    out = hot_rows.unionByName(cold_rows)
    return out.select(F.col("id").alias("doc_id"), "class_id", (F.col("linked") + F.col("n") - F.lit(1)).cast("long").alias("n_links"), F.col("class_size").cast("long").alias("class_size"), F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest id, with the columns it has."""
    spark = docs.sparkSession
    found, _ = classes(docs)
    ids = materialize(spark, found.groupBy("component").agg(F.min(F.struct("node", "mark")).alias("m")).select("m.node", "m.mark"), "kept")
    k, i, d, r = fresh(docs, "__key", "__id", "__did", "__row")
    keep = ids.select(F.col("mark").alias(k), F.col("node").alias(i))
    rows = docs.withColumn(d, text_key(F.col("text"))).withColumn(r, F.lit(0))
    rows = rows.join(keep, (F.col(d) == F.col(k)) & F.col("doc_id").cast("long").eqNullSafe(F.col(i)), "left_semi")
    # rows that repeat both id and text are one document
    return rows.dropDuplicates([d, "doc_id"]).select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)
