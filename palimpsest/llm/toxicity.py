"""Toxicity by maximum-scoring segments.

Tokens get log-odds of standing in toxic text. A token's rate has a Dirichlet prior centred on the rate
of its prefix (6, 5, 4, 3 letters, then all text), so a word seen a few times, or never, leans on its
word family. Function words score about nothing, and a constant drift makes the mean score negative, so
a linear-time scan finds every maximal segment of the token sequence whose sum can't be raised by
trimming or by extending it: the passages.

A passage of score S among n tokens is expected K n exp(-lambda S) times by chance. lambda comes from the
token scores of clean training text, K from the best passages of clean training documents. Passages
that are significant add up to a document's evidence, which a logistic curve, fitted on the training
documents, turns into a score from 0 to 1.

Learned from labelled rows only: from all of them up to MAX_TRAINING_DOCS, beyond that from those whose
hashed ids come first; these rows are written to a table once and bound the lexicon. Language, source and id
are no inputs of a score. DRIFT, STRENGTH and FAR were chosen by folds inside the training fold alone.

Defined results: a null or empty text has no passages and gets the score of no evidence; without a
toxic or without a clean training document no token scores and the score is the share of toxic
training documents (0 if none); several labels of one id count as toxic if any does; repeated rows
are scored each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, latest, materialize, slim, table

MAX_TRAINING_DOCS = 20_000
PREFIXES = (3, 4, 5, 6)
STRENGTH = 2.0
DRIFT = 1.2
CLIP = 6.0
#: Standard errors between a node's rate and that of all documents: so few by chance among all words
#: that those hardly matter.
FAR = 4.5
#: A passage counts if chance gives fewer than this many in a document.
SIGNIFICANT = 0.05
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = -2.0
    weights: list[float] = field(default_factory=lambda: [-40.0, 0.0, 0.0])

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def nodes_of(word: str) -> list[str]:
    """The word's chain of families, from wide to narrow, and itself."""
    return [f"{word[:n]}*" for n in PREFIXES if len(word) > n] + [word]


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, sum), by the linear-time scan.

    ``scores`` holds positions and scores of the tokens that score above 0; all others score ``-drift``.
    A list of candidate segments is kept with the sums before their left and right ends; a new
    positive token is merged into earlier candidates until the condition of maximality holds.
    """
    found: list[list] = []  # left, right, sum before left, sum at right
    total, at = 0.0, 0
    for pos, s in scores:
        total -= drift * (pos - at)
        at = pos + 1
        left, low = pos, total
        total += s
        high = total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([left, pos, low, high, j])
                break
            left, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def score_of(self, word: str) -> float:
        for node in reversed(nodes_of(word)):
            if node in self.model.scores:
                return self.model.scores[node] - DRIFT
        return -DRIFT

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Every maximal segment of the text, and the number of tokens."""
        ws, cache = words(text), self.cache
        if len(cache) > 200_000:
            cache.clear()
        for w in set(ws):
            if w not in cache:
                cache[w] = self.score_of(w)
        # tokens below the drift lower the sum as well: the positive ones carry what came before them
        scores = list(map(cache.__getitem__, ws))
        plus, owed = [], 0.0
        for i, s in enumerate(scores):
            if s > 0:
                plus.append((i, s, owed))
                owed = 0.0
            elif s < -DRIFT:
                owed += s + DRIFT
        if not any(o for _, _, o in plus):
            return segments([(i, s) for i, s, _ in plus], DRIFT), len(ws)
        return _segments_with_costs(plus), len(ws)

    def evidence(self, text: str | None) -> tuple[float, float, int]:
        """(log of the chance expectation of the best passage, negated; the sum of that over
        significant passages; their number)."""
        found, n = self.passages(text)
        base = self.model.log_k + math.log(max(n, 1))
        logs = [self.model.lam * s - base for _, _, s in found]
        good = [x for x in logs if x > -math.log(SIGNIFICANT)]
        return max(logs, default=-base), sum(good), len(good)

    def probability(self, best: float, total: float) -> float:
        w = self.model.weights
        z = w[0] + w[1] * _squash(best) + w[2] * math.log1p(max(0.0, total))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _segments_with_costs(plus: list[tuple[int, float, float]]) -> list[tuple[int, int, float]]:
    """As ``segments`` where tokens between positive ones cost more than the drift."""
    shifted, extra = [], 0.0
    for i, s, owed in plus:
        extra += -owed / DRIFT
        shifted.append((i + extra, s))
    where = {p: i for (p, _), (i, _, _) in zip(shifted, plus, strict=True)}
    return [(where[a], where[b], s) for a, b, s in segments(shifted, DRIFT)]


def _squash(best: float) -> float:
    return max(-10.0, min(12.0, best))


def training_fold(doc_id: Column) -> Column:
    """True for rows that may be learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def training_rows(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column | None = None, limit: int = MAX_TRAINING_DOCS) -> DataFrame:
    """(text, label) of labelled documents: all, or ``limit`` of them by hash of their ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    if may_learn is not None:
        known = known.filter(may_learn)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # at most ``limit`` rows of two numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", may_learn: Column | None = None) -> Model:
    # written once: a few passes over these rows follow
    rows = materialize(docs.sparkSession, training_rows(docs, labels, label, may_learn), "toxicity-rows")

    def nodes(b):
        out: dict[str, list] = {"node": [], "toxic": []}
        for text, lab in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
            seen = {n for w in set(words(text)) for n in nodes_of(w)} | {""}
            out["node"] += seen
            out["toxic"] += [lab] * len(seen)
        return out

    counts = arrow_rows(rows, nodes, "node string, toxic int").groupBy("node").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("c"))
    model = Model()
    total = counts.filter("node = ''").first()
    t_all, c_all = (int(total.t), int(total.c)) if total else (0, 0)
    if not t_all or not c_all:
        share = t_all / max(1, t_all + c_all)
        model.weights = [math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0), 0.0, 0.0]
        return model
    # nodes whose rate is far from that of all documents, in standard errors, on either side
    rate = t_all / (t_all + c_all)
    n = F.col("t") + F.col("c")
    far = F.abs(F.col("t") - n * rate) / F.sqrt(n * rate * (1 - rate))
    # of a bounded number of documents
    kept = {r.node: (int(r.t), int(r.c)) for r in counts.filter((F.col("node") != "") & (far > F.lit(FAR))).collect()}
    model.scores = lexicon(kept, rate)
    return calibrate(rows, model)


def lexicon(counts: dict[str, tuple[int, int]], rate: float) -> dict[str, float]:
    """Log-odds of each node against all documents; the prior of a node is its nearest wider node."""
    rates: dict[str, float] = {}

    def prior(node: str) -> float:
        if node.endswith("*"):
            wider = [f"{node[:n]}*" for n in PREFIXES if n < len(node) - 1]
        else:
            wider = nodes_of(node)[:-1]
        return next((rates[w] for w in reversed(wider) if w in rates), rate)

    for node in sorted(counts, key=lambda x: (not x.endswith("*"), len(x), x)):
        t, c = counts[node]
        rates[node] = (t + STRENGTH * prior(node)) / (t + c + STRENGTH)
    odds = lambda p: math.log(p / (1 - p))
    return {k: round(max(-CLIP, min(CLIP, odds(p) - odds(rate))), 4) for k, p in rates.items()}


def _scorer(model_json: str) -> Scorer:
    return latest("toxicity", "scorer", model_json, lambda: Scorer(Model(**json.loads(model_json))))


def calibrate(rows: DataFrame, model: Model) -> Model:
    """lambda, K and the logistic curve, from bounded training rows."""
    import numpy as np

    given = rows.sparkSession.sparkContext.broadcast(model.to_json())

    def token_scores(b):
        from collections import Counter

        scorer, seen = _scorer(given.value), Counter()
        for text, lab in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
            if not lab:
                seen.update(round(scorer.score_of(w), 1) for w in words(text))
        return {"score": list(seen), "n": list(seen.values())}

    null = arrow_rows(rows, token_scores, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    s = np.array([r.score for r in null], float)
    p = np.array([r.n for r in null], float)
    p /= max(1.0, p.sum())
    model.lam = _lambda(s, p)
    model.log_k = 0.0
    again = rows.sparkSession.sparkContext.broadcast(model.to_json())

    def best(b):
        scorer, out = _scorer(again.value), {"label": b["label"].to_pylist(), "n": [], "best": [], "sums": []}
        for text in b["text"].to_pylist():
            found, n = scorer.passages(text)
            out["n"].append(n)
            out["sums"].append([x for _, _, x in found])
            out["best"].append(max(out["sums"][-1], default=0.0))
        return out

    got = arrow_rows(rows, best, "label int, n int, best double, sums array<double>").collect()
    clean = [model.lam * r.best - math.log(max(r.n, 1)) for r in got if not r.label and r.best > 0]
    # the mean of the largest of many is log K plus Euler's constant; a few labels may be wrong
    model.log_k = float(np.median(clean)) + math.log(math.log(2)) if clean else -2.0
    scorer = Scorer(model)
    x, y = [], []
    for r in got:
        base = model.log_k + math.log(max(r.n, 1))
        logs = [model.lam * v - base for v in r.sums]
        x.append([1.0, _squash(max(logs, default=-base)), math.log1p(sum(v for v in logs if v > -math.log(SIGNIFICANT)))])
        y.append(1.0 if r.label else 0.0)
    scorer.model.weights = logistic(np.array(x), np.array(y)).tolist()
    return model


def _lambda(s, p) -> float:
    """The positive root of E[exp(lambda * score)] = 1; 1 if the scores have none."""
    import numpy as np

    if not len(s) or s.max() <= 0 or (s * p).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    value = lambda x: float((p * np.exp(x * s)).sum()) - 1
    while value(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def logistic(x, y, ridge: float = 1e-2, steps: int = 60):
    """Weights of a logistic regression with a ridge, by Newton's method."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, best (log of how rare the best passage is), n_passages, passages (first and
    last token, significant ones) of every document."""
    given = docs.sparkSession.sparkContext.broadcast(model.to_json())

    def run(b):
        scorer = _scorer(given.value)
        out: dict[str, list] = {"score": [], "best": [], "n_passages": [], "passages": []}
        for text in b["text"].to_pylist():
            found, n = scorer.passages(text)
            base = scorer.model.log_k + math.log(max(n, 1))
            logs = [(scorer.model.lam * s - base, a, z) for a, z, s in found]
            good = [x for x in logs if x[0] > -math.log(SIGNIFICANT)]
            best = max((x[0] for x in logs), default=-base)
            out["score"].append(scorer.probability(best, sum(x[0] for x in good)))
            out["best"].append(best)
            out["n_passages"].append(len(good))
            out["passages"].append([{"first": a, "last": z, "rarity": x} for x, a, z in good])
        return {"doc_id": b["doc_id"]} | out

    return arrow_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, best double, n_passages int, passages array<struct<first:int,last:int,rarity:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, may_learn=training_fold(F.col("doc_id")))
    return score(docs, model).select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with the columns they have."""
    given = docs.sparkSession.sparkContext.broadcast(model.to_json())

    def run(batches):
        scorer = _scorer(given.value)
        for b in slim(batches):
            keep = [scorer.probability(*scorer.evidence(t)[:2]) < threshold for t in b["text"].to_pylist()]
            import pyarrow as pa

            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the training fold among the documents given."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels"), may_learn=training_fold(F.col("doc_id"))))
