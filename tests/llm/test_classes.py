"""Near-copies of texts and vectors against brute force."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import embedding_dedup as E
from palimpsest.llm import near_dedup as N

# texts


def brute(texts: list, threshold=N.THRESHOLD):
    """Classes (lists of positions) by comparing all pairs: counts of five-word runs, weighted."""
    import re

    def shingles(t):
        ws = re.findall(r"[^\W_]+", (t or "").lower())
        k = min(5, len(ws))
        return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else Counter()

    sets = [shingles(t) for t in texts]
    df = Counter(s for x in sets for s in x)
    idf = {s: float(np.float32(N.idf_of(np.array([n]), len(texts))[0])) for s, n in df.items()}
    sets = [{s: c * idf[s] for s, c in x.items()} for x in sets]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = []
    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        both = sum(min(w, b[s]) for s, w in a.items() if s in b)
        union = sum(a.values()) + sum(b.values()) - both
        sim = both / union if union else 0.0
        if texts[i] == texts[j] or sim >= threshold:
            pairs.append((i, j, sim))
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))], pairs


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    texts = []
    for size in (1, 1, 1, 2, 3, 8, 30):
        base = [word() for _ in range(rnd.randint(60, 200))]
        for _ in range(size):
            ws = base[:]
            for _ in range(rnd.randint(0, 4)):
                ws[rnd.randrange(len(ws))] = word()
            texts.append(" ".join(ws))
    texts += [texts[5], texts[5], "Short one.", "short ONE", "other", "", "", " ... ", None, None, "x " * 3000, "x " * 3001]
    return texts


def test_classes_against_brute_force(make):
    texts = corpus()
    want, _ = brute(texts)
    rows = N.label(make(*enumerate(texts))).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: r.class_id for r in rows}
    assert [got[i] for i in range(len(texts))] == want
    size = Counter(want)
    assert all(r.class_size == size[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in rows)


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    want, pairs = brute([d.text for d in docs])
    ids = [d.doc_id for d in docs]
    got = {r.doc_id: r for r in N.query(spark, sf).collect()}
    assert [got[i].class_id for i in ids] == [ids[k] for k in want]
    degree = Counter(ids[k] for i, j, _ in pairs for k in (i, j))
    assert all(got[i].n_links <= degree[i] for i in ids)


def test_one_of_each_class_stays(make):
    texts = corpus(2)
    docs = make(*enumerate(texts))
    want, _ = brute(texts)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_repeated_rows_and_empty_tables(make):
    docs = make((1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "z"), (1, "other text"))
    rows = N.label(docs).collect()
    assert len(rows) == 5
    assert sorted((r.doc_id or 0, r.class_size) for r in rows) == [(0, 1), (1, 1), (1, 3), (1, 3), (2, 3)]
    assert N.keep_one(docs).count() == 3
    assert N.label(docs.limit(0)).count() == 0 == N.keep_one(docs.limit(0)).count()


def test_links_that_leaders_miss(make):
    """b and c are near, and both are met by a leader that is near neither: the pair is found all the same."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    a = base[:]
    for i in rnd.sample(range(400), 22):
        a[i] = f"a{i}"
    b = base[:]
    for i in rnd.sample(range(400), 14):
        b[i] = f"b{i}"
    c = b[:]
    c[7] = "other"
    texts = [" ".join(x) for x in (a, b, c)]
    want, pairs = brute(texts)
    assert want == [0, 1, 1]
    got = {r.doc_id: r.class_id for r in N.label(make(*enumerate(texts))).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_samples_agree_as_often_as_sets_are_similar():
    s = N.Sampler()
    rnd = np.random.Generator(np.random.PCG64(3))
    got, want = [], []
    for _ in range(120):
        h = np.unique(rnd.integers(0, 1 << 63, 60, dtype=np.uint64))
        wa, wb = rnd.choice([0.5, 0.7, 1.0, 2.0, 3.0], len(h)), rnd.choice([0.5, 1.0, 1.0, 2.0], len(h))
        got.append((s.sample(h, wa) == s.sample(h, wb)).mean())
        want.append(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(got) - np.mean(want)) < 0.02
    assert (s.sample(h, wa) == s.sample(h, wa)).all()


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, i) for i in range(2001, 2100)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in N.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: top(i) for e in edges if e[0] != e[1] for i in e}
    assert got == want


# vectors


def vectors():
    rnd = np.random.Generator(np.random.PCG64(9))
    rows = []
    for label in (0, 1):
        for size in (1, 1, 2, 5, 40, 130):
            centre = rnd.normal(size=24)
            for _ in range(size):
                rows.append((len(rows), [float(x) for x in centre + rnd.normal(size=24) * 0.1], label))
        rows += [(len(rows) + i, [float(x) for x in rnd.normal(size=24)], label) for i in range(150)]
    rows += [(len(rows) + i, rows[3][1], 0) for i in range(90)]
    rows += [(9001, None, 0), (9002, [0.0] * 24, 0), (9003, [math.nan] + [1.0] * 23, 0), (9004, rows[0][1], None), (9005, [None] + [1.0] * 23, 0), (9006, [], 0), (9007, [1.0, 2.0], 0), (9008, [2.0, 4.0], 0), (9009, [math.inf] * 24, 1)]
    return rows


def brute_vectors(rows):
    """(links of each id, smallest reachable id) by comparing all pairs."""
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = Counter()
    root = {r[0]: r[0] for r in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.array(r[1], np.float32).astype(float) for r in good]
    unit = [x / np.linalg.norm(x) for x in unit]
    for (i, a), (j, b) in combinations(enumerate(good), 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[i] @ unit[j] >= E.THRESHOLD:
            links[a[0]] += 1
            links[b[0]] += 1
            p, q = top(a[0]), top(b[0])
            root[max(p, q)] = min(p, q)
    return links, {i: top(i) for i in root}


def sizes(rows):
    return E.Sizes(shard=rows // 2, graph=rows, pivots=4, block=2 * rows)


@pytest.mark.parametrize("shard", [2000, 60])
def test_vectors_against_brute_force(spark, shard):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in E.label_components(df, sizes=sizes(shard)).collect()}
    assert set(got) == {r[0] for r in rows}
    links, top = brute_vectors(rows)
    assert sum(links.values()) > 3000
    assert all(got[i].n_links <= links[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.999 * sum(links.values())
    assert all(got[i].component_id == top[i] and got[i].kept == (top[i] == i) for i in got)
    audit = E.audit(df, every=10, sizes=sizes(shard))
    assert audit["true"] > 100 and audit["lost"] <= 0.001 * audit["true"] and not audit["wrong"]


@pytest.mark.parametrize("shard", [2000, 60])
def test_isolated_pairs(spark, shard):
    """Pairs just in range, and nothing else near: none is lost, and both ends of each count it."""
    rnd = np.random.Generator(np.random.PCG64(21))
    n, dim = 1500, 16
    a = rnd.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rnd.normal(size=(n, dim))
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rnd.uniform(0.9805, 0.99, (n, 1))
    b = c * a + np.sqrt(1 - c * c) * z
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([a, b]).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in E.label_components(df, sizes=sizes(shard)).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = (v @ v.T >= E.THRESHOLD).sum(axis=1) - 1
    assert sum(r.n_links for r in got.values()) >= 0.999 * true.sum() and all(got[i].n_links <= true[i] for i in got)
    assert sum(r.n_links for r in got.values()) % 2 == 0
    assert all(got[i].n_links == got[i + n].n_links for i in range(n) if true[i] == true[i + n] == 1)
    assert all(got[i].component_id == got[i + n].component_id for i in range(n) if got[i].n_links)


def test_dense_group_of_distinct_vectors(spark, tmp_path):
    """20,000 distinct vectors, nearly all near one another, in a label without other vectors, and some that are alone."""
    rnd = np.random.Generator(np.random.PCG64(4))
    v = np.concatenate([rnd.normal(size=64) + rnd.normal(size=(20_000, 64)) * 0.1, rnd.normal(size=(500, 64))]).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": list(v), "label": np.int32(0)}).to_parquet(tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = E.label_components(df).toPandas().set_index("vec_id")
    assert len(got) == len(v)
    assert (got.component_id[:20_000] == 0).all() and (got.n_links[20_000:] == 0).all()
    u = v[:20_000].astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert all(got.n_links[i] == (u @ u[i] >= E.THRESHOLD).sum() - 1 for i in range(0, 20_000, 500))


def test_tasks_of_a_large_shard_are_bounded(spark):
    """A shard that can't be cut: every two nodes meet once, and no group grows with the shard."""
    n = 20_000
    held = spark.range(n).select(F.xxhash64("id").alias("mark"), F.lit(0).cast("long").alias("label"), F.lit(1).alias("dim"), F.lit(0).alias("shard"), F.lit(n).cast("long").alias("size"))
    groups = E.in_blocks(held).groupBy("shard", "low", "high").agg(F.count("*").alias("all"), F.sum((F.col("block") == F.col("low")).cast("int")).alias("of_low")).collect()
    assert max(r["all"] for r in groups) <= 2.2 * E.SIZES.block
    assert sum(r["all"] * (r["all"] - 1) // 2 if r.low == r.high else r.of_low * (r["all"] - r.of_low) for r in groups) == n * (n - 1) // 2


def test_both_ends_of_a_link_meet():
    """Of two vectors in range of one another, both are in the earlier one of their homes, whatever the pivots."""
    rnd = np.random.Generator(np.random.PCG64(6))
    centre = rnd.normal(size=64)
    v = np.concatenate([centre + rnd.normal(size=(2000, 64)) * s for s in (0.1, 0.2)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    home, there = E.within(v, v[::50], E.THRESHOLD)
    x, y = np.nonzero(v @ v.T >= E.THRESHOLD)
    assert len(x) > 100_000
    assert there[x, np.minimum(home[x], home[y])].all()


def test_wide_numbers_keep_their_precision(spark):
    """Vectors of doubles: their cosine is 0.98 but for less than a float can tell."""
    c = E.THRESHOLD
    rows = [(i, [c + d, math.sqrt(1 - (c + d) ** 2)], 0) for i, d in enumerate((1e-11, -1e-11))] + [(2, [1.0, 0.0], 0)]
    got = {r.vec_id: r.n_links for r in E.label_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: 2, 1: 1, 2: 1}


def test_vectors_of_an_empty_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert E.label_components(df.limit(0)).count() == 0
    assert E.query(spark, sf).count() == df.count()


def test_vectors_query(spark, sf):
    from compare import same

    same(E.query(spark, sf), E.SQL, sf)


def test_plan_of_large_buckets_gives_the_same(make, monkeypatch):
    """Bucket sizes from which pivots are drawn and parts are made decide about plans, not about classes."""
    texts = corpus(5)
    want, _ = brute(texts)
    for small, rounds, part in ((0, 0, 2), (2, 2, 3)):
        monkeypatch.setattr(N, "SMALL", small)
        monkeypatch.setattr(N, "PIVOT_ROUNDS", rounds)
        monkeypatch.setattr(N, "PART_ROWS", part)
        got = {r.doc_id: r.class_id for r in N.label(make(*enumerate(texts))).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_star_of_copies_that_are_not_near_one_another(make):
    """A text and edited copies: those near it are one class, and the rest stay as they are, except two
    whose edits agree."""
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for k in range(60):
        ws = base[:]
        for i in rnd.sample(range(300), rnd.choice([3, 9])):
            ws[i] = f"x{k}a{i}"
        texts.append(" ".join(ws))
    last = texts[-1].split()
    last[0] = "another"
    texts.append(" ".join(last))
    want, _ = brute(texts)
    got = {r.doc_id: r.class_id for r in N.label(make(*enumerate(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert 10 < Counter(want)[0] < 50
