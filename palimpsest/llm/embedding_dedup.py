"""Near-duplicate vectors by a flat, robustly pruned proximity graph.

Vectors are compared within a label alone, by cosine in double precision. Rows of one vector are one
node. Then:

1. Each label is cut into overlapping cluster shards. A shard of more than ``Sizes.graph`` rows is cut around pivots
   (nodes of its own, by hash, no two within the threshold of one another); a node goes to its nearest
   pivot's shard, its home, and to each earlier one that may be the home of a node in range of it. So the two
   ends of a link meet in one shard: the earlier one of their homes. Shards are cut again, level by level,
   while that lowers the number of rows that tasks have to read, by a sample of the shard's rows; their number
   grows with the table, and pivots stay in tables.
2. Each shard builds a graph: a node's candidates are its nearest neighbours in the shard, some at random and
   the medoid; pruning drops a candidate if one that is kept is nearer to it, by a factor, than the node is.
   Edges are added in reverse and pruned again.
3. A node's adjacency lists from all its shards are united.
4. In each of its shards a node is searched over the united lists: greedily from the shard's medoid with a beam,
   then expanding from every node within reach (twice the angle of the threshold, by the triangle inequality)
   to its neighbours until nothing new is in range. Cosines of what is found are exact.
5. A pair that either end finds counts once, for both ends, in the one shard where it belongs. A shard sends on
   the number of links of each node and a spanning forest of its links, never pairs of a group;
   components are joined in tables.
6. A shard that can't be cut to its use (a dense group, or vectors without clusters) is dealt in blocks of
   ``Sizes.block`` rows or so; every two blocks are compared whole, in a task each. That finds every link.

``audit`` compares the pairs found with those of brute force, for every id divisible by 100 against all rows.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite component, and
rows with a null label or null id, link with nothing: n_links 0, own id as component, kept. Rows of the
same vector and label link with one another; a repeated id is one more row. Vectors of different
lengths aren't compared. The component is the smallest id reachable; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .near_dedup import components

THRESHOLD = 0.98
#: Rows of a shard meet what is known of it in this many parts.
PARTS = 64
DEGREE, POOL, RANDOM_EDGES, ALPHA = 24, 48, 8, 1.2
BEAM = 12
HOT, SALTS = 64, 16


class Sizes(NamedTuple):
    """Home rows a shard is meant to have; rows up to which it isn't cut; pivots of one cut at most; rows of a
    block; rows of a shard's sample. They bound what a task holds; links don't depend on them."""

    shard: int = 1000
    graph: int = 2000
    pivots: int = 64
    block: int = 4096
    sample: int = 2048


SIZES = Sizes()


def valid(embedding: Column, label: Column) -> Column:
    """True if the vector may be compared; never null."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(embedding, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & embedding.isNotNull() & good, F.lit(False))


def unit(column) -> list:
    """Rows of unit length, in double precision."""
    import numpy as np

    v = np.array(column.tolist(), dtype=np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow, no underflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def prune(v, node: int, pool, limit: int = DEGREE):
    """Robust pruning of candidates, nearest first."""
    import numpy as np

    near = v[pool] @ v[node]
    order = np.argsort(-near, kind="stable")
    pool, near = pool[order], near[order]
    dist = np.sqrt(np.maximum(0.0, 2 - 2 * near))
    among = np.sqrt(np.maximum(0.0, 2 - 2 * (v[pool] @ v[pool].T)))
    alive = np.ones(len(pool), bool)
    kept = []
    for k in range(len(pool)):
        if alive[k]:
            kept.append(int(pool[k]))
            if len(kept) == limit:
                break
            alive &= ALPHA * among[k] > dist
    return kept


def reach_of(threshold: float) -> float:
    """The cosine of twice the threshold's angle: what two vectors in range of a third have at least."""
    return 2 * threshold * threshold - 1 - 1e-9


def build_graph(v, threshold: float = THRESHOLD) -> list[list[int]]:
    """Adjacency lists of one shard. Reverse edges within reach are kept beyond the degree: who finds
    its neighbours is found by them."""
    import numpy as np

    n = len(v)
    if n <= 1:
        return [[] for _ in range(n)]
    rng = np.random.Generator(np.random.PCG64(7))
    medoid = int((v @ v.mean(axis=0)).argmax())
    lists: list[list[int]] = []
    k = min(POOL, n - 1)
    for i in range(0, n, 512):
        sims = v[i : i + 512] @ v.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        for row, node in enumerate(range(i, i + len(sims))):
            pool = np.unique(np.concatenate([near[row], rng.integers(0, n, RANDOM_EDGES), [medoid]]))
            lists.append(prune(v, node, pool[pool != node]))
    back: list[list[int]] = [[] for _ in range(n)]
    for node, edges in enumerate(lists):
        for e in edges:
            back[e].append(node)
    grown: list[list[int]] = []
    for node in range(n):
        both = np.unique(np.array(lists[node] + back[node], dtype=np.int64))
        if len(both) <= DEGREE:
            grown.append(both.tolist())
            continue
        into = np.array(back[node], dtype=np.int64)
        near = into[v[into] @ v[node] >= reach_of(threshold)].tolist() if len(into) else []
        grown.append(sorted({*prune(v, node, both), *near}))
    return grown


def search(v, lists: list, medoid: int, q: int, threshold: float):
    """Nodes in range of node ``q`` (without it), by greedy search and range expansion."""
    import numpy as np

    reach = reach_of(threshold)
    target = v[q]
    seen = {medoid}
    beam = [(float(v[medoid] @ target), medoid)]
    opened: set[int] = set()
    found: dict[int, float] = {medoid: beam[0][0]}
    while True:
        node = next((x for _, x in beam if x not in opened), None)
        if node is None or beam[0][0] > threshold and node not in (x for _, x in beam[:4]):
            break
        opened.add(node)
        new = [x for x in lists[node] if x not in seen]
        if new:
            seen.update(new)
            sims = (v[new] @ target).tolist()
            found.update(zip(new, sims, strict=True))
            beam = sorted(beam + list(zip(sims, new, strict=True)), reverse=True)[:BEAM]
    # the node is a row of the index itself: its own lists are part of the range
    front = [x for x, s in found.items() if s >= reach]
    if q not in found:
        front.append(q)
        found[q] = 1.0
    done: set[int] = set()
    while front:
        done.update(front)
        new = list({y for x in front for y in lists[x]} - found.keys())
        if new:
            found.update(zip(new, (v[new] @ target).tolist(), strict=True))
        near = {y for x in front for y in lists[x]}
        front = [y for y in near if found[y] >= reach and y not in done]
    hits = np.array([x for x, s in found.items() if s >= threshold - 1e-9 and x != q], dtype=np.int64)
    return hits[cosine(v, hits, q) >= threshold] if len(hits) else hits


def cosine(v, rows, q: int):
    return (v[rows] * v[q]).sum(axis=1)


def nodes_of(vectors: DataFrame, traced: Column | None = None) -> DataFrame:
    """A row per label and vector: mark (64-bit key), label, dim, embedding, node (smallest id), n, traced."""
    good = vectors.filter(valid(F.col("embedding"), F.col("label")) & F.col("vec_id").isNotNull())
    some = F.lit(False) if traced is None else F.coalesce(F.bool_or(traced), F.lit(False))
    groups = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), some.alias("traced"))
    return groups.select(F.xxhash64("label", "embedding").alias("mark"), "label", F.size("embedding").alias("dim"), "embedding", "node", "n", "traced")


def thinned(v, threshold: float):
    """The rows of ``v``, in their order, that aren't in range of one kept before."""
    import numpy as np

    kept = np.empty_like(v)
    n = 0
    for x in v:
        if not n or (kept[:n] @ x).max() < threshold:
            kept[n] = x
            n += 1
    return kept[:n]


def within(v, centres, threshold: float):
    """(home, there): each row's nearest pivot; by row and pivot, whether the row goes to its shard: if it is
    the home, or an earlier one that may be the nearest of a vector in range of the row. If x is in range of
    y and no nearer to pivot q than to p, y lies at most the threshold's angle beyond the plane halfway
    between p and q."""
    import numpy as np

    sims = v @ centres.T
    home = sims.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres[home] @ centres.T)))
    sine = (1 - threshold * threshold) ** 0.5
    there = np.take_along_axis(sims, home[:, None], axis=1) - sims <= sine * apart + 1e-9
    there &= np.arange(len(centres)) < home[:, None]
    there[np.arange(len(v)), home] = True
    return home, there


def rows_sent(v, centres, threshold: float, total: float, sizes: Sizes) -> float:
    """Estimate, from sampled rows ``v`` of ``total``, of the rows that all tasks of these shards read."""
    import numpy as np

    _, there = within(v, centres, threshold)
    size = there.sum(axis=0) * (total / len(v))
    return float(np.where(size <= sizes.graph, size, size * np.ceil(size / sizes.block)).sum())


def pivots_of(v, total: int, threshold: float, sizes: Sizes):
    """Pivots for a shard of ``total`` rows with the sampled rows ``v``: of the first ones, thinned out, so many that
    the fewest rows are sent; none if that is one shard. Any choice gives the same links."""
    centres = thinned(v[: 2 * sizes.pivots], threshold)[: min(sizes.pivots, max(2, total // sizes.shard))]
    counts = [len(centres) >> i for i in range(len(centres).bit_length())]
    best = min(counts, key=lambda n: rows_sent(v, centres[:n], threshold, total, sizes), default=1)
    return centres[:best] if best > 1 else None


SHARD = ["label", "dim", "shard"]
_ROW = "label long, dim int, shard long, depth int, homes long, mark long, n long, traced boolean, embedding "
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _sized(rows: DataFrame) -> DataFrame:
    """Adds the number of rows of each shard. The rows of a large one meet it in parts."""
    sizes = rows.groupBy(*SHARD).agg(F.count("*").alias("size")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(PARTS)).cast("int")).join(sizes, [*SHARD, "part"]).drop("part")


def cut(big: DataFrame, depth: int, threshold: float, sizes: Sizes) -> DataFrame:
    """The rows of shards that are too large, in shards of the next level; those of shards that no cut helps get
    ``final``. Pivots are chosen from a sample of each shard and meet its rows block by block."""

    def choose(pdf):
        import pandas as pd

        pdf = pdf.sort_values("turn", kind="stable")
        found = pivots_of(unit(pdf["embedding"]), int(pdf["size"].iloc[0]), threshold, sizes)
        some = [] if found is None else [[x.tolist() for x in found]]
        return pdf.iloc[: len(some)][[*SHARD, "size"]].assign(pivots=pd.Series(some, dtype=object, index=pdf.index[: len(some)]))

    turn = F.xxhash64("mark", F.lit(5 + 2 * depth))
    sample = big.select(*SHARD, "size", turn.alias("turn"), "embedding").filter(F.pmod(F.shiftrightunsigned("turn", 8), F.ceil(F.col("size") / F.lit(sizes.sample))) == 0)
    chosen = sample.groupBy(*SHARD).applyInPandas(choose, "label long, dim int, shard long, size long, pivots array<array<double>>")
    chosen = materialize(big.sparkSession, chosen, "pivots")
    parts = F.ceil(F.col("size") / F.lit(sizes.block)).cast("int")
    given = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), parts - F.lit(1)))).select(*SHARD, "part", "pivots")
    rows = big.withColumn("part", F.pmod(F.xxhash64("mark", F.lit(6 + 2 * depth)), parts).cast("int")).drop("size")

    def assign(pdf, about):
        import numpy as np

        if not len(about) or not len(pdf):
            return pdf.drop(columns="part").assign(final=True)
        centres = np.array([list(x) for x in about["pivots"].iloc[0]])
        out = []
        v = unit(pdf["embedding"])
        for i in range(0, len(v), 512):
            home, there = within(v[i : i + 512], centres, threshold)
            row, col = np.nonzero(there)
            some = pdf.iloc[i + row].drop(columns="part")
            some["homes"] = some["homes"].to_numpy() | ((col == home[row]).astype(np.int64) << depth)
            some["shard"] = some["shard"].to_numpy() * 2 * sizes.pivots + 1 + col
            out.append(some.assign(depth=depth + 1, final=False))
        import pandas as pd

        return pd.concat(out)

    return rows.groupBy(*SHARD, "part").cogroup(given.groupBy(*SHARD, "part")).applyInPandas(assign, f"{_ROW}{big.schema['embedding'].dataType.simpleString()}, final boolean")


def shards_of(nodes: DataFrame, threshold: float, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """(graphs, dense): the rows of shards for a graph each, and of those to be compared block by block. ``homes`` has
    a bit for each level at which the shard is the row's home: a pair belongs to the shard if their bits
    together are all ``depth`` of them."""
    spark = nodes.sparkSession
    rows = nodes.select("label", "dim", F.lit(0).cast("long").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("homes"), "mark", "n", "traced", "embedding")
    graphs: list[DataFrame] = []
    dense: list[DataFrame] = []
    for depth in range(9):  # as many levels as a shard's number has room for, for 64^9 shards
        sized = materialize(spark, _sized(rows), f"sized-{depth}")
        graphs.append(sized.filter(F.col("size") <= F.lit(sizes.graph)).select(*_NAMES))
        big = sized.filter(F.col("size") > F.lit(sizes.graph))
        if not big.limit(1).count():
            break
        lower = materialize(spark, cut(big, depth, threshold, sizes), f"cut-{depth}")
        dense.append(lower.filter("final"))
        rows = lower.filter("not final").select(*_NAMES)
    else:
        dense.append(rows)
    none = rows.limit(0)
    join = lambda frames: reduce(DataFrame.unionByName, [x.select(*_NAMES) for x in frames], none)
    return join(graphs), _sized(join(dense))


class Links:
    """What a task finds: rows linked with each vector, a forest of marks, pairs of traced marks."""

    def __init__(self, marks, n, homes, traced, depth: int):
        import numpy as np

        self.marks, self.n, self.homes, self.traced, self.full = marks, n.astype(np.float64), homes, traced, (1 << depth) - 1
        self.linked = np.zeros(len(marks), np.int64)
        self.root = np.arange(len(marks))
        self.pairs: list = []

    def add(self, rows, cols, hit, both: bool) -> None:
        """``hit`` by rows and columns (positions). ``both``: count for the columns as well."""
        import numpy as np

        hit &= (self.homes[rows][:, None] | self.homes[cols][None]) == self.full
        self.linked[rows] += np.rint(hit @ self.n[cols]).astype(np.int64)
        if both:
            self.linked[cols] += np.rint(self.n[rows] @ hit).astype(np.int64)
        for r in np.flatnonzero(hit.any(axis=1)):
            met = self.root[np.append(cols[hit[r]], rows[r])]
            if (low := met.min()) != met.max():
                self.root[np.isin(self.root, np.unique(met))] = low
        for k in np.flatnonzero(self.traced[rows]):
            self.pairs += [(self.marks[rows[k]], m) for m in self.marks[cols[hit[k]]]]
        if both:
            for k in np.flatnonzero(self.traced[cols]):
                self.pairs += [(self.marks[cols[k]], m) for m in self.marks[rows[hit[:, k]]]]

    def frame(self):
        import numpy as np
        import pandas as pd

        some, joined = np.flatnonzero(self.linked), np.flatnonzero(self.root != np.arange(len(self.root)))
        pairs = np.array(self.pairs, np.int64).reshape(-1, 2)
        none = np.zeros(len(some), np.int64)
        return pd.DataFrame(
            {
                "kind": np.repeat([DEGREE_OF, FOREST, PAIR], [len(some), len(joined), len(pairs)]).astype(np.int32),
                "a": np.concatenate([self.marks[some], self.marks[self.root[joined]], pairs[:, 0]]),
                "b": np.concatenate([none, self.marks[joined], pairs[:, 1]]),
                "linked": np.concatenate([self.linked[some], np.zeros(len(joined) + len(pairs), np.int64)]),
            }
        )


DEGREE_OF, FOREST, PAIR = 0, 1, 2
_FOUND = "kind int, a long, b long, linked long"


def in_blocks(dense: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """Rows of shards with ``size`` rows, dealt so that every two blocks of rows meet once: a task each, of about
    2 x ``sizes.block`` rows at most, however large the shard."""
    blocks = F.ceil(F.col("size") / F.lit(sizes.block)).cast("int")
    rows = dense.withColumn("block", F.pmod(F.xxhash64("mark", F.lit(9)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - F.lit(1))))
    return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "size")


def links_by_blocks(dense: DataFrame, threshold: float, sizes: Sizes) -> DataFrame:
    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("mark", kind="stable")
        v, block = unit(pdf["embedding"]), pdf["block"].to_numpy()
        found = Links(pdf["mark"].to_numpy(), pdf["n"].to_numpy(), pdf["homes"].to_numpy(), pdf["traced"].to_numpy(), int(pdf["depth"].iloc[0]))
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        rows, cols = np.flatnonzero(block == low), np.flatnonzero(block == high)
        there = v[cols]
        for i in range(0, len(rows), 512):
            part = rows[i : i + 512]
            sims = v[part] @ there.T
            hit = sims >= threshold
            for r, c in np.argwhere(np.abs(sims - threshold) < 1e-9):
                hit[r, c] = (there[c] * v[part[r]]).sum() >= threshold
            hit &= part[:, None] != cols[None]
            found.add(part, cols, hit, low != high)
        return found.frame()

    return in_blocks(dense, sizes).groupBy(*SHARD, "low", "high").applyInPandas(run, _FOUND)


def links_by_graphs(graphs: DataFrame, threshold: float) -> DataFrame:
    spark = graphs.sparkSession

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("mark", kind="stable")
        marks = pdf["mark"].to_numpy()
        lists = build_graph(unit(pdf["embedding"]), threshold)
        return pd.DataFrame({"mark": marks, "edges": [marks[x].tolist() for x in lists]})

    edges = graphs.select(*SHARD, "mark", "embedding").groupBy(*SHARD).applyInPandas(build, "mark long, edges array<long>")
    united = edges.groupBy("mark").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    united = materialize(spark, united, "united")

    def find(pdf):
        import numpy as np

        pdf = pdf.sort_values("mark", kind="stable").reset_index(drop=True)
        v, marks = unit(pdf["embedding"]), pdf["mark"].to_numpy()
        where = {m: i for i, m in enumerate(marks.tolist())}
        lists = [[where[m] for m in e if m in where] if e is not None else [] for e in pdf["edges"]]
        medoid = int((v @ v.mean(axis=0)).argmax())
        hit = np.zeros((len(v), len(v)), bool)
        for q in range(len(v)):
            hit[q, search(v, lists, medoid, q, threshold)] = True
        everyone = np.arange(len(v))
        found = Links(marks, pdf["n"].to_numpy(), pdf["homes"].to_numpy(), pdf["traced"].to_numpy(), int(pdf["depth"].iloc[0]))
        found.add(everyone, everyone, hit | hit.T, False)  # found by one end, it is a link of both
        return found.frame()

    return graphs.join(united, "mark").groupBy(*SHARD).applyInPandas(find, _FOUND)


def find_links(nodes: DataFrame, threshold: float = THRESHOLD, sizes: Sizes = SIZES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(degrees, forest, pairs): mark, linked (rows linked in other vectors); a, b of a spanning forest; a, b of
    all links found of traced nodes ``a``."""
    graphs, dense = shards_of(nodes, threshold, sizes)
    found = materialize(nodes.sparkSession, links_by_graphs(graphs, threshold).unionByName(links_by_blocks(dense, threshold, sizes)), "searched")
    of = lambda kind: found.filter(F.col("kind") == F.lit(kind))
    return of(DEGREE_OF).groupBy(F.col("a").alias("mark")).agg(F.sum("linked").alias("linked")), of(FOREST).select("a", "b"), of(PAIR).select("a", "b")


def _rows(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))


def label_components(vectors: DataFrame, threshold: float = THRESHOLD, sizes: Sizes = SIZES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    rows = _rows(vectors)
    nodes = materialize(spark, nodes_of(rows), "nodes")
    degrees, forest, _ = find_links(nodes, threshold, sizes)
    comp = components(spark, forest, "vectors")
    known = nodes.select("mark", "node", "n").join(comp.withColumnRenamed("node", "mark"), "mark", "left").withColumn("component", F.coalesce("component", "mark")).join(degrees, "mark", "left")
    known = materialize(spark, known, "known")
    ids = known.groupBy("component").agg(F.min("node").alias("component_id"))
    known = materialize(spark, known.join(ids, "component").select("mark", "n", "component_id", F.coalesce("linked", F.lit(0)).alias("linked")), "labelled")
    # rows of a vector of many are dealt over parts
    hot = known.filter(F.col("n") > F.lit(HOT)).select(F.col("mark").alias("hot_mark"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("hot_part"), F.col("n").alias("hot_n"), F.col("component_id").alias("hot_id"), F.col("linked").alias("hot_linked"))
    hot = materialize(spark, hot, "hot-vectors")
    good = valid(F.col("embedding"), F.col("label")) & F.col("vec_id").isNotNull()
    keyed = rows.select("vec_id", F.when(good, F.xxhash64("label", "embedding")).alias("mark"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("part"))
    alone = keyed.filter("mark is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    met = keyed.filter("mark is not null").join(hot, (F.col("mark") == F.col("hot_mark")) & (F.col("part") == F.col("hot_part")), "left")
    of_hot = met.filter("hot_mark is not null").select("vec_id", (F.col("hot_linked") + F.col("hot_n") - F.lit(1)).alias("n_links"), F.col("hot_id").alias("component_id"))
    others = met.filter("hot_mark is null").select("vec_id", "mark").join(known.filter(F.col("n") <= F.lit(HOT)), "mark").select("vec_id", (F.col("linked") + F.col("n") - F.lit(1)).alias("n_links"), "component_id")
    return alone.unionByName(of_hot).unionByName(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(vectors: DataFrame, threshold: float = THRESHOLD, every: int = 100, sizes: Sizes = SIZES) -> dict[str, int]:
    """Pairs of nodes, of ids divisible by ``every`` with all others: how many brute force finds (true), how many
    of them were lost, and how many found are not among them (wrong). The nodes asked for are a stated set;
    so many at a time meet all rows in batches."""
    spark = vectors.sparkSession
    nodes = materialize(spark, nodes_of(_rows(vectors), F.col("vec_id") % F.lit(every) == 0), "audited")
    found = find_links(nodes, threshold, sizes)[2].distinct()
    asked = nodes.filter("traced").select("mark", "label", "dim", "embedding")
    turns = -(-asked.count() // sizes.block)
    truth = spark.createDataFrame([], "a long, b long")
    for turn in range(turns):
        block = asked.filter(F.pmod(F.xxhash64("mark", F.lit(13)), F.lit(turns)) == turn).toPandas()
        by = {k: (unit(g["embedding"]), g["mark"].to_numpy()) for k, g in block.groupby(["label", "dim"])}

        def run(batches, by=by):
            import numpy as np
            import pandas as pd

            for b in batches:
                for key, part in b.groupby(["label", "dim"]):
                    if key in by:
                        q, marks = by[key]
                        there = part["mark"].to_numpy()
                        row, col = np.nonzero((unit(part["embedding"]) @ q.T >= threshold) & (there[:, None] != marks[None]))
                        yield pd.DataFrame({"a": marks[col], "b": there[row]})

        truth = truth.unionByName(nodes.select("mark", "label", "dim", "embedding").mapInPandas(run, "a long, b long"))
    truth = materialize(spark, truth, "truth")
    return {"true": truth.count(), "lost": truth.join(found, ["a", "b"], "left_anti").count(), "wrong": found.join(truth, ["a", "b"], "left_anti").count()}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_components(table(spark, sf_dir, "embeddings"))


#: Vectors with an id each and of one length, as the table has them.
SQL = f"""
WITH RECURSIVE good AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.a LEFT JOIN degree d ON e.vec_id = d.a
"""
