"""Quality by hierarchical empirical Bayes: a document's own evidence, and its site's.

A classifier on measures of the text gives each document a probability under the global prior. Grouped
aggregation over all documents gives each host, and each path of a host, its mean of those
probabilities; a site's mean is shrunk towards that of the level above (path to host, host to all), the
more the fewer documents it has. How strongly, is learned from the data: the spread between hosts
beyond chance (method of moments) sets the strength of the prior. The shrunk prior of its path then
replaces the global prior in the document's odds.

``documents`` has no address: its source stands for the host and its language for the path under it.
``host_path`` takes both from a URL column.

Learned from labelled rows only, at most MAX_TRAINING_DOCS (those whose hashed ids come first).

Defined results: a null text counts as empty; null sites form a site of their own; an empty text has
no measures and gets the lowest probability of a junk-free text's complement by the curve like any other;
without labels of both kinds every document gets the same evidence and is kept; repeated rows are scored
each by itself; an empty table gives no rows; other columns pass through ``drop_low_quality``.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, fresh, materialize, slim, table
from .toxicity import logistic, training_rows

MAX_TRAINING_DOCS = 20_000
THRESHOLD = 0.5
#: Bounds of the prior's strength, in documents, and of what a site may add to a document's log-odds.
LEAST_STRENGTH, MOST_STRENGTH, MOST_SHIFT = 4.0, 1e4, 2.0
#: A hot site's rows meet its prior in this many parts.
SALTS = 16
MEASURES = ("upper", "symbol", "digit", "distinct", "word_length", "marked", "short_runs", "pipes", "top_word", "repeats", "log_words", "line_repeats", "caps_words")
_MARKED = re.compile(r"\w(?:[^\w\s.,;:?'\")\]-]|!){2,}(?=\s|$)")


def measures(text: str | None) -> list[float]:
    t = text or ""
    ws = t.split()
    n, k = max(1, len(t)), max(1, len(ws))
    letters = max(1, len(re.findall(r"[^\W\d_]", t)))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", t))
    counts = Counter(ws)
    top = counts.most_common(1)[0][1] if ws else 0
    lines = [x for x in t.split("\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(ws, ws[1:], strict=False))
    caps = sum(1 for w in ws if len(w) > 1 and w.isupper())
    return [
        upper / letters,
        len(re.findall(r"[^\w\s]", t)) / n,
        len(re.findall(r"\d", t)) / n,
        len(counts) / k**0.9,
        min(20.0, sum(map(len, ws)) / k) / 10,
        len(_MARKED.findall(t)) / k,
        sum(1 for w in ws if len(w) == 1) / k,
        counts["|"] / k,
        top / k if k > 8 else 0.0,
        repeats / k,
        math.log1p(len(ws)) / 10,
        1 - len(set(lines)) / max(1, len(lines)),
        caps / k,
    ]


def _design(x):
    """Measures, their square roots and a constant."""
    import numpy as np

    x = np.clip(np.asarray(x, float).reshape(-1, len(MEASURES)), 0, 5)
    return np.hstack([x, np.sqrt(x), np.ones((len(x), 1))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> list[float]:
    """Weights of the classifier; none if there are no labels of both kinds."""
    import numpy as np

    def run(b):
        return {"x": [measures(t) for t in b["text"].to_pylist()], "label": b["label"]}

    rows = arrow_rows(training_rows(docs, labels, label, limit=MAX_TRAINING_DOCS), run, "x array<double>, label int").collect()
    y = np.array([1.0 if r.label else 0.0 for r in rows])
    if not 0 < y.sum() < len(y):
        return []
    return logistic(_design([r.x for r in rows]), y, ridge=0.3).tolist()


def probabilities(weights: list[float], texts: list) -> list[float]:
    import numpy as np

    if not weights:
        return [0.999] * len(texts)
    z = _design([measures(t) for t in texts]) @ np.array(weights)
    return (1 / (1 + np.exp(-np.clip(z, -12, 12)))).tolist()


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and first part of the path of a URL."""
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))
    return host, F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*/([^/?#]*)", 1)


def site_priors(evidence: DataFrame) -> DataFrame:
    """(host, path, shift, host_prior, path_prior): what a site adds to the log-odds of its documents.

    ``evidence`` has host, path and p. Sums per site are partial before they are shuffled; a few
    moments over hosts come to the driver."""
    paths = evidence.groupBy("host", "path").agg(F.count("p").alias("n"), F.sum("p").alias("s"))
    paths = materialize(evidence.sparkSession, paths, "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    m = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("k"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("ss"), F.sum(F.col("hn").cast("double") * F.col("hn")).alias("nn")).first()
    n, s, k = float(m.n or 0), float(m.s or 0.0), int(m.k or 0)
    mean = min(1 - 1e-4, max(1e-4, s / n)) if n else 0.5
    strength = MOST_STRENGTH
    if k > 1 and n > k:
        # between-host sum of squares against what chance gives for shares of this mean
        between = float(m.ss) - s * s / n
        chance = (k - 1) * mean * (1 - mean)
        spread = (between - chance) / max(1e-9, n - float(m.nn) / n)
        if spread > 0:
            strength = mean * (1 - mean) / spread - 1
    strength = min(MOST_STRENGTH, max(LEAST_STRENGTH, strength))
    hosts = hosts.withColumn("host_prior", (F.col("hs") + F.lit(strength * mean)) / (F.col("hn") + F.lit(strength))).select(F.col("host").alias("h"), "host_prior")
    found = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    found = found.withColumn("path_prior", (F.col("s") + F.lit(strength) * F.col("host_prior")) / (F.col("n") + F.lit(strength)))
    odds = F.log(F.col("path_prior") / (F.lit(1.0) - F.col("path_prior"))) - F.lit(math.log(mean / (1 - mean)))
    return found.select("host", "path", "n", "host_prior", "path_prior", F.greatest(F.lit(-MOST_SHIFT), F.least(F.lit(MOST_SHIFT), odds)).alias("shift"))


def _with_shift(rows: DataFrame, sites: DataFrame, host: str, path: str, salt_by: Column, *more: str) -> DataFrame:
    """Joins each row with its site; the rows of a hot site are spread over SALTS parts."""
    h, p, s, t = fresh(rows, "__host", "__path", "__salt", "__salt_of_site")
    right = sites.select(F.col("host").alias(h), F.col("path").alias(p), *more).withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn(t, F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    return left.join(right, F.col(host).eqNullSafe(F.col(h)) & F.col(path).eqNullSafe(F.col(p)) & (F.col(t) == F.col(s))).drop(h, p, s, t)


def posterior(p: str, shift: str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + (F.lit(1.0) / F.col(p) - F.lit(1.0)) * F.exp(-F.col(shift)))


def evidence(docs: DataFrame, weights: list[float], host: Column, path: Column) -> DataFrame:
    def run(b):
        return {"doc_id": b["doc_id"], "host": b["host"], "path": b["path"], "p": probabilities(weights, b["text"].to_pylist())}

    return arrow_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", host.cast("string").alias("host"), path.cast("string").alias("path")), run, "doc_id long, host string, path string, p double")


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, p_text, host_prior, path_prior, score, keep of every document."""
    spark = docs.sparkSession
    found = materialize(spark, evidence(docs, fit(docs, labels), F.col("source") if host is None else host, F.col("lang") if path is None else path), "evidence")
    rows = _with_shift(found, site_priors(found), "host", "path", F.col("doc_id"), "shift", "host_prior", "path_prior")
    return rows.select("doc_id", F.col("p").alias("p_text"), "host_prior", "path_prior", posterior("p", "shift").alias("score")).withColumn("keep", F.col("score") >= F.lit(THRESHOLD))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents at or above the threshold, with the columns they have."""
    spark = docs.sparkSession
    weights = fit(docs, labels)
    sites = materialize(spark, site_priors(evidence(docs, weights, F.col("source"), F.col("lang"))), "priors")
    p, s = fresh(docs, "__p", "__shift")
    schema = docs.withColumn(p, F.lit(0.0)).schema

    def run(batches):
        import pyarrow as pa

        for b in slim(batches):
            yield b.append_column(p, pa.array(probabilities(weights, b["text"].to_pylist()), pa.float64()))

    rows = _with_shift(docs.mapInArrow(run, schema), sites.withColumnRenamed("shift", s), "source", "lang", F.col("doc_id"), s)
    return rows.filter(posterior(p, s) >= F.lit(threshold)).select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))
