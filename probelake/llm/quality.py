"""Quality classifier by hierarchical empirical Bayes.

1. A logistic model over a dozen surface features gives each document's own
   evidence.  It is fitted on a bounded sample of the labelled documents.
2. Every document counts towards its site: with its label where it has one, with
   its evidence otherwise.  Grouped sums give each host (``source``) and each
   path below it (``source`` and ``lang``) a mean.
3. A path's mean is shrunk towards its host's, the host's towards the global
   mean.  Each level's prior strength is its beta-binomial moment estimate, so
   sparse sites fall back on their parents.
4. A document's posterior log odds are its own evidence plus ``site_weight``
   times its path's log odds relative to the global ones, both without what the
   document itself counted for, so that no label judges its own document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelake.llm.common import cut, packed, unpacked, whole_texts

FEATURES = 12
_MARKS = np.frombuffer(b"#$%&*!|", "uint8")


def features(text: str | None) -> list[float]:
    """Surface features of a text; zeros but for the first two if it is null or empty."""
    words = (text or "").split()
    if not words:
        return [1.0, 1.0] + [0.0] * (FEATURES - 2)
    hist = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), "uint8"), minlength=256)
    n, nw = max(1, int(hist.sum())), len(words)
    marks = hist[_MARKS] / nw
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum() + hist[128:].sum() // 2)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / nw
    return [
        1.0,
        0.0,
        upper / max(1, upper + lower),
        float(min(1.0, marks[:5].sum())),
        float(min(1.0, marks[5])),
        float(min(1.0, marks[6])),
        again,
        len(set(words)) / nw,
        float(hist[48:58].sum()) / n,
        float(np.log1p(nw)) / 10,
        float(min(n / nw, 30)) / 10,
        float(min(hist[10] / nw, 1.0)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def feature_column(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's steps; zeros without rows."""
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def evidence(x: Column, weights: np.ndarray) -> Column:
    """Log odds that a linear model gives the feature array."""
    return reduce(lambda a, b: a + b, [x[i] * float(w) for i, w in enumerate(weights)])


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def prior_strength(groups: DataFrame, mean: Column) -> float:
    """Beta-binomial moment estimate of the strength of a prior with the given means; groups: n and good."""
    r = groups.where("n > 1").select(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.pow(F.col("good") / F.col("n") - mean, 2) * F.col("n")).alias("between"),
        F.sum(mean * (1 - mean) * F.col("n")).alias("within"),
    ).first()
    if not r["k"] or not r["within"]:
        return 100.0
    binomial = r["within"] / r["n"]  # variance of one outcome
    spread = max(1e-6, (r["between"] / r["n"] - binomial * r["k"] / r["n"]) / binomial)  # intra-site correlation
    return float(min(1e5, max(1.0, 1 / spread - 1)))


class SiteModel:
    """Weights, global sums, prior strengths of hosts and paths, the table of paths
    (host, path, n, good, host_n, host_good, p_host, p_path) and the labels (doc_id, y) that were counted."""

    def __init__(self, weights: np.ndarray, n: int, good: float, strengths: tuple[float, float], paths: DataFrame, rows: int, labels: DataFrame, labelled: int):
        self.weights, self.n, self.good, self.strengths = weights, n, good, strengths
        self.paths, self.rows, self.labels, self.labelled = paths, rows, labels, labelled

    @property
    def mean(self) -> float:
        return self.good / self.n if self.n else 0.5


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> SiteModel:
    """Fit on all of ``docs`` (doc_id, text, source, lang) and ``labels`` (doc_id, quality).

    The logistic weights come from about ``sample`` labelled documents (never over
    twice as many), chosen by hashed id; site counts from every document.  Null hosts and paths
    are sites of their own.  Null or repeated labels: the mean of those not null.
    """
    whole_texts(docs.sparkSession)
    seen = cut(docs.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), feature_column("text").alias("x")))
    label = cut(labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y")))
    marked = seen.join(label, "doc_id", "left")
    known = marked.where("y is not null")
    share = min(1.0, sample / max(1, known.count()))
    rows = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1e6)).limit(2 * sample).select("x", "y").collect()
    w = fit_logistic(np.array([r["x"] for r in rows]).reshape(len(rows), FEATURES), np.array([float(r["y"] >= 0.5) for r in rows]))
    y = F.coalesce("y", _sigmoid(evidence(F.col("x"), w)))
    paths = cut(marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(y).alias("good")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    n, good = total["n"] or 0, float(total["good"] or 0.0)
    mean = good / n if n else 0.5
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    a = prior_strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("_host"), F.col("n").alias("host_n"), F.col("good").alias("host_good"), ((F.col("good") + a * mean) / (F.col("n") + a)).alias("p_host"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    b = prior_strength(paths, F.col("p_host"))
    paths = cut(paths.withColumn("p_path", (F.col("good") + b * F.col("p_host")) / (F.col("n") + b)))
    return SiteModel(w, n, good, (a, b), paths, paths.count(), label, label.count())


def judge(docs: DataFrame, model: SiteModel, threshold: float = 0.5, site_weight: float = 0.5, broadcast_rows: int = 100_000, broadcast_labels: int = 500_000) -> DataFrame:
    """(_doc, p_doc, p_host, p_path, posterior, keep): whole rows of ``docs``, kept with a posterior of at least ``threshold``.

    What a row counted for (its label, else its evidence) is taken out of its path,
    its host and the whole before they judge it.  Rows of sites that the model does
    not know have null site means and are judged by their evidence alone.  The table
    of paths is broadcast if it has at most ``broadcast_rows`` rows, that of labels
    (some 40 bytes each) if at most ``broadcast_labels``; larger ones are joined.
    """
    small = lambda df, rows, most: F.broadcast(df) if rows <= most else df
    own = packed(docs).withColumn("x", feature_column("_doc.text")).withColumn("evidence", evidence(F.col("x"), model.weights)).drop("x")
    label = model.labels.select(F.col("doc_id").alias("_labelled"), F.col("y").alias("_y"))
    own = own.join(small(label, model.labelled, broadcast_labels), F.col("_doc.doc_id") == F.col("_labelled"), "left").withColumn("mine", F.coalesce("_y", _sigmoid(F.col("evidence"))))
    joined = own.join(small(model.paths, model.rows, broadcast_rows), F.col("_doc.source").eqNullSafe(F.col("host")) & F.col("_doc.lang").eqNullSafe(F.col("path")), "left")
    a, b = model.strengths
    mean = F.when(F.lit(model.n > 1), (F.lit(model.good) - F.col("mine")) / float(max(1, model.n - 1))).otherwise(F.lit(0.5))
    joined = joined.withColumn("base", mean).withColumn("host_p", (F.col("host_good") - F.col("mine") + a * F.col("base")) / (F.col("host_n") - 1 + a))
    joined = joined.withColumn("path_p", (F.col("good") - F.col("mine") + b * F.col("host_p")) / (F.col("n") - 1 + b))
    site = F.coalesce(_logit(F.col("path_p")) - _logit(F.col("base")), F.lit(0.0))
    posterior = _sigmoid(F.col("evidence") + site_weight * site)
    judged = joined.select("_doc", _sigmoid(F.col("evidence")).alias("p_doc"), F.col("host_p").alias("p_host"), F.col("path_p").alias("p_path"), posterior.alias("posterior"))
    return judged.withColumn("keep", F.col("posterior") >= threshold)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_doc, p_host, p_path, posterior and keep of every row of ``docs``.

    Repeated rows are judged alike; a null or empty text has evidence of its own
    (that it has no words); null hosts and paths are sites; ties at the threshold are kept.
    """
    out = judge(docs.select("doc_id", "text", "source", "lang"), fit(docs, labels))
    return out.select(F.col("_doc.doc_id").alias("doc_id"), "p_doc", "p_host", "p_path", "posterior", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    return unpacked(judge(docs, fit(docs, labels)).where("keep"))
