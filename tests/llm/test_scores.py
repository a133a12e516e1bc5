"""Toxicity and quality: the scans against brute force, accuracy on held-out labels, odd inputs."""

import random

import pytest

from palimpsest.llm import quality as Q
from palimpsest.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def maximal(scores):
    """All maximal scoring segments by their definition: the best one, then those on both sides of it. Of
    equal sums the shorter one: a maximal segment has no part of the same sum."""

    def solve(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (best is None or total > best[2] + 1e-9 or total > best[2] - 1e-9 and j - i < best[1] - best[0]):
                    best = (i, j, total)
        if best is None:
            return []
        return solve(a, best[0]) + [best] + solve(best[1] + 1, b)

    return solve(0, len(scores))


def test_segments_are_all_maximal_ones():
    rnd = random.Random(1)
    for _ in range(300):
        scores = [rnd.choice([-1.0, -1.0, -1.0, 0.37, 1.21, 2.83]) for _ in range(rnd.randint(0, 30))]
        got = T.segments([(i, s) for i, s in enumerate(scores) if s > 0], 1.0)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in maximal(scores)]
        assert all(abs(s - sum(scores[a : b + 1])) < 1e-9 for a, b, s in got)


def test_tokens_that_cost_more_than_the_drift():
    model = T.Model(scores={"bad": 4.0, "good": -3.0})
    scorer = T.Scorer(model)
    rnd = random.Random(2)
    for _ in range(200):
        ws = [rnd.choice(["bad", "good", "x", "y", "z"]) for _ in range(rnd.randint(0, 25))]
        want = maximal([scorer.score_of(w) for w in ws])
        got, n = scorer.passages(" ".join(ws))
        assert n == len(ws)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_lambda_is_the_root():
    import numpy as np

    s, p = np.array([-1.0, 1.0]), np.array([0.75, 0.25])
    assert abs(T._lambda(s, p) - np.log(3)) < 1e-9
    assert T._lambda(np.array([-1.0]), np.array([1.0])) == 1.0


def test_held_out_toxicity(spark):
    rows = T.query(spark, SF)
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    marks = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    all_rows = rows.collect()
    assert len(all_rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in all_rows)
    held = [r for r in rows.join(marks, "doc_id").collect() if r.held_out]
    bad = [r for r in held if r.toxic]
    hit = [r for r in held if r.predicted]
    assert sum(r.predicted for r in bad) >= 0.7 * len(bad)
    assert sum(r.toxic for r in hit) >= 0.9 * len(hit)


def test_fold_is_the_crc(spark):
    import zlib

    from pyspark.sql import functions as F

    rows = spark.range(300).select("id", T.training_fold(F.col("id")).alias("t")).collect()
    assert all(r.t == (zlib.crc32(str(r.id).encode()) % 3 != 1) for r in rows)


def test_toxicity_of_odd_inputs(spark, make):
    docs = make((1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "fine"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.01 for r in T.score(docs, T.fit(docs, labels)).collect())  # none is toxic
    rows = [(i, f"word{i} the idiot said moron" if i % 2 else f"word{i} the fine day was good") for i in range(60)]
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.fit(make(*rows), marks)
    got = sorted((r.doc_id or 0, r.score) for r in T.score(docs, model).collect())
    assert len(got) == 5 and got[0][1] < 0.5 and got[1][1] < 0.5 and got[3][1] == got[4][1] > 0.7
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2]
    assert T.score(docs.limit(0), model).count() == 0 == T.drop_toxic(docs.limit(0), model).count()


def test_quality_query(spark):
    rows = Q.query(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    marks = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    both = rows.join(marks, "doc_id").collect()
    good, bad = [r for r in both if r.quality], [r for r in both if not r.quality]
    assert sum(r.keep for r in good) >= 0.99 * len(good)
    assert sum(not r.keep for r in bad) >= 0.95 * len(bad)


def test_quality_on_unseen_labels(spark):
    from pyspark.sql import functions as F

    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    unseen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 1
    both = Q.score(docs, marks.filter(~unseen)).join(marks.filter(unseen), "doc_id").collect()
    assert len(both) > 50
    assert sum(r.keep != bool(r.quality) for r in both) <= 0.04 * len(both)


def test_quality_posterior_by_hand(spark):
    """Priors and posteriors of the whole query again, in plain Python."""
    import math
    from collections import defaultdict

    docs = {r.doc_id: (r.source, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.query(spark, SF).collect()
    host, path = defaultdict(list), defaultdict(list)
    for r in rows:
        host[docs[r.doc_id][0]].append(r.p_text)
        path[docs[r.doc_id]].append(r.p_text)
    n, mean = len(rows), sum(r.p_text for r in rows) / len(rows)
    between = sum(len(x) * (sum(x) / len(x) - mean) ** 2 for x in host.values())
    spread = (between - (len(host) - 1) * mean * (1 - mean)) / (n - sum(len(x) ** 2 for x in host.values()) / n)
    strength = min(Q.MOST_STRENGTH, max(Q.LEAST_STRENGTH, mean * (1 - mean) / spread - 1 if spread > 0 else Q.MOST_STRENGTH))
    for r in rows:
        h, p = docs[r.doc_id][0], docs[r.doc_id]
        at_host = (sum(host[h]) + strength * mean) / (len(host[h]) + strength)
        at_path = (sum(path[p]) + strength * at_host) / (len(path[p]) + strength)
        shift = max(-Q.MOST_SHIFT, min(Q.MOST_SHIFT, math.log(at_path / (1 - at_path)) - math.log(mean / (1 - mean))))
        odds = r.p_text / (1 - r.p_text) * math.exp(shift)
        assert abs(r.host_prior - at_host) < 1e-6 and abs(r.path_prior - at_path) < 1e-6
        assert abs(r.score - odds / (1 + odds)) < 1e-6 and r.keep == (r.score >= Q.THRESHOLD)


def test_long_texts_are_measured_alike():
    text = "Words ½ ² Ⅷ of a plain sentence. "
    a, b = Q.measures(text * 50), Q.measures(text * 70)
    assert abs(a[Q.MEASURES.index("upper")] - b[Q.MEASURES.index("upper")]) < 1e-9


def test_toxicity_by_hand():
    """Log-odds of a chain of nodes under Dirichlet priors, and the score of a text, computed again."""
    import math

    got = T.lexicon({"idi*": (8, 2), "idiot": (3, 0)}, 0.1)
    wide = (8 + T.STRENGTH * 0.1) / (10 + T.STRENGTH)
    narrow = (3 + T.STRENGTH * wide) / (3 + T.STRENGTH)
    odds = lambda p: math.log(p / (1 - p) / (0.1 / 0.9))
    assert got == {"idi*": round(min(T.CLIP, odds(wide)), 4), "idiot": round(min(T.CLIP, odds(narrow)), 4)}
    model = T.Model(scores=got, lam=0.9, log_k=-1.0, weights=[-3.0, 0.5, 1.5])
    best, total, n = T.Scorer(model).evidence("you idiot you")
    want = 0.9 * (got["idiot"] - T.DRIFT) - (-1.0 + math.log(3))
    assert abs(best - want) < 1e-9 and n == (want > -math.log(T.SIGNIFICANT)) and abs(total - n * want) < 1e-9
    z = -3.0 + 0.5 * want + 1.5 * math.log1p(total)
    assert abs(T.Scorer(model).probability(best, total) - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_of_a_very_long_text():
    model = T.Model(scores={"idiot": 4.0})
    found, n = T.Scorer(model).passages("fine day " * 300_000 + "idiot idiot " + "fine day " * 300_000)
    assert n == 1_200_002 and [(a, b) for a, b, _ in found] == [(600_000, 600_001)]


def test_site_priors_shrink(spark):
    rows = [("big", "a", 0.9)] * 400 + [("big", "b", 0.1)] * 2 + [("small", "a", 0.1)] * 2 + [("poor", "a", 0.2)] * 400 + [(None, None, 0.5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, p double")
    got = {(r.host, r.path): r for r in Q.site_priors(df).collect()}
    mean = sum(r[2] for r in rows) / len(rows)
    assert 0.85 < got["big", "a"].path_prior < 0.9
    assert got["big", "b"].path_prior > 0.4  # two documents say little against their host
    assert abs(got["small", "a"].path_prior - mean) < abs(0.1 - mean) * 0.7
    assert got["poor", "a"].shift < 0 < got["big", "a"].shift
    assert (None, None) in got


def test_quality_of_odd_inputs(spark, make):
    docs = make((1, None), (2, ""), (3, "x"), (3, "x"), (None, "word " * 50000))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.drop_low_quality(docs, labels)
    assert out.columns == docs.columns and out.count() == 5  # one kind of label teaches nothing
    assert Q.score(docs, labels).count() == 5
    assert Q.score(docs.limit(0), labels).count() == 0 == Q.drop_low_quality(docs.limit(0), labels).count()


def test_host_path(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("https://User@Example.org:80/news/x?y#z",), ("//a.b",), ("nothing",), (None,)], "u string")
    host, path = Q.host_path(F.col("u"))
    assert [tuple(r) for r in rows.select(host, path).collect()] == [("example.org", "news"), ("a.b", ""), ("", ""), (None, None)]


@pytest.mark.parametrize("text, much", [("WORDS!! SHOUTED!! HERE!!", "caps_words"), ("a | b | c | d", "pipes"), ("so so so so so so so so so so", "repeats")])
def test_measures(text, much):
    k = Q.MEASURES.index(much)
    assert Q.measures(text)[k] > 0.3 > Q.measures("A plain sentence of some words, as people write them.")[k]
