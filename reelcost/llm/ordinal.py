"""Toxicity as an ordered grade: cumulative-link (proportional-odds) regression.

P(grade <= k) = s(c_k - w.x): all thresholds share the weights w. The expected severity is the sum
of P(grade >= k) over k. Features are sparse: words and word beginnings, weighted by presence and
rate. The model is fitted on a bounded sample of labelled documents; every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, kept, text_of

# At most so many labelled documents are fitted: those whose ids hash lowest.
SAMPLE_DOCS = 6_000
MAX_FEATURES = 512
MIN_DOCS = 5
# A feature is used if it speaks for toxicity: by so many standard errors, and by so large a log ratio.
# Its weight can't fall below 0, so no other word makes up for an insult.
MIN_Z = 5.0
MIN_LOG_RATIO = 1.0
PREFIXES = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> tuple[Counter, int]:
    """Counts of words and of the beginnings of longer words, and the number of words."""
    words = Counter(_WORD.findall(text.lower()))
    out = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out, sum(words.values())


def weight(count: int, words: int) -> float:
    return 1.0 + float(np.log1p(100.0 * count / max(1, words)))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=list)
    reject_from: float = float("inf")
    held_out_accuracy: float = float("nan")

    def severity(self, score: np.ndarray) -> np.ndarray:
        return sum((_sigmoid(score - c) for c in self.cuts), np.zeros_like(score))

    def grade(self, score: np.ndarray) -> np.ndarray:
        """Most probable grade."""
        if not self.cuts:
            return np.zeros(len(score), np.int64)
        at_least = np.stack([np.ones_like(score), *[_sigmoid(score - c) for c in self.cuts], np.zeros_like(score)])
        return np.argmax(at_least[:-1] - at_least[1:], axis=0)

    def score(self, text: str) -> float:
        """w.x; only words and beginnings that the model knows are looked at."""
        counts: Counter = Counter()
        words = Counter(_WORD.findall(text.lower()))
        known = self.weights
        for w, n in words.items():
            if w in known:
                counts[w] += n
            for k in PREFIXES:
                if len(w) > k and (p := w[:k] + "*") in known:
                    counts[p] += n
        if not counts:
            return 0.0
        total = sum(words.values())
        return float(sum(known[f] * weight(n, total) for f, n in sorted(counts.items())))


def fit_cumulative_link(x: np.ndarray, grade: np.ndarray, grades: int, ridge: float = 1e-3, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood by Adam steps, weights of 0 or more; cuts stay ordered as first cut plus positive gaps."""
    n, d = x.shape
    w, first, gaps = np.zeros(d), np.array([1.0]), np.zeros(max(0, grades - 2))
    params = np.concatenate([w, first, gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, cuts = params[:d], params[d] + np.concatenate([[0.0], np.cumsum(np.exp(params[d + 1 :]))])
        s = x @ w
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = edges[grade + 1] - s, edges[grade] - s
        cdf = lambda z: np.where(np.isinf(z), z > 0, _sigmoid(np.where(np.isinf(z), 0, z)))
        fh, fl = cdf(hi), cdf(lo)
        p = np.maximum(fh - fl, 1e-9)
        dh, dl = fh * (1 - fh) / p, fl * (1 - fl) / p
        gw = -(x.T @ (dl - dh)) / n + ridge * w
        gc = np.array([-(dh[grade == k].sum() - dl[grade == k + 1].sum()) / n for k in range(grades - 1)])
        ggaps = np.array([gc[k + 1 :].sum() * np.exp(params[d + 1 + k]) for k in range(grades - 2)])
        g = np.concatenate([gw, [gc.sum()], ggaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        params[:d] = np.maximum(params[:d], 0)
    return params[:d], params[d] + np.concatenate([[0.0], np.cumsum(np.exp(params[d + 1 :]))])


def _log_ratio(a: int, n1: int, b: int, n0: int) -> float:
    return float(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)))


def _train(rows: pd.DataFrame, max_features: int) -> tuple[dict[str, float], list[float], float, float]:
    """Grades, features, weights, cuts and the calibrated rejection threshold from the sample."""
    toxic, held = rows["toxic"].to_numpy() == 1, rows["held"].to_numpy()
    bags = [dict(zip(f, c)) for f, c in zip(rows["features"], rows["counts"])]
    words = rows["words"].to_numpy()
    fit = ~held
    n1, n0 = int((toxic & fit).sum()), int((~toxic & fit).sum())
    if not n1 or not n0:
        return {}, [], float("inf"), float("nan")
    c1, c0 = Counter(), Counter()
    for b, t, f in zip(bags, toxic, fit):
        if f:
            (c1 if t else c0).update(b.keys())
    gain = {}
    for f, a in c1.items():
        b = c0.get(f, 0)
        if a + b >= MIN_DOCS:
            p1, p0, p = a / n1, b / n0, (a + b) / (n1 + n0)
            z = abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
            if z >= MIN_Z and _log_ratio(a, n1, b, n0) >= MIN_LOG_RATIO:
                gain[f] = z
    picked = sorted(gain, key=lambda f: (-gain[f], f))[:max_features]
    place = {f: i for i, f in enumerate(picked)}
    if not picked:
        return {}, [], float("inf"), float("nan")
    x, rate = np.zeros((len(bags), len(picked))), np.zeros(len(bags))
    for i, b in enumerate(bags):
        for f, n in b.items():
            if f in place:
                x[i, place[f]] = weight(n, words[i])
                rate[i] += n if not f.endswith("*") else 0
    rate = rate / np.maximum(1, words)
    middle = np.median(rate[toxic & fit])
    grade = np.where(toxic, np.where(rate > middle, 2, 1), 0)
    grades = 3 if {1, 2} <= set(grade[fit]) else 2
    grade = np.minimum(grade, grades - 1)
    w, cuts = fit_cumulative_link(x[fit], grade[fit], grades)
    severity = sum(_sigmoid(x @ w - c) for c in cuts)
    check = held if toxic[held].any() and not toxic[held].all() else fit
    s, t = severity[check], toxic[check]
    # Between neighbours in the order of severity (geometric middle), where fewest documents are judged wrongly.
    order = np.argsort(s, kind="stable")
    s, t = s[order], t[order]
    missed, wrong = np.concatenate([[0], np.cumsum(t)]), (~t).sum() - np.concatenate([[0], np.cumsum(~t)])
    edge = np.concatenate([[s[0] / 2], np.sqrt(s[1:] * s[:-1]), [2 * s[-1]]])
    ok = np.concatenate([[True], s[1:] > s[:-1], [True]])
    at = int(np.argmin(np.where(ok, missed + wrong, np.inf)))
    return {f: float(w[i]) for f, i in place.items()}, [float(c) for c in cuts], float(edge[at]), float(((s >= edge[at]) == t).mean())


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_docs: int = SAMPLE_DOCS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on at most ``sample_docs`` labelled documents; a fifth of them calibrates the threshold.

    Grade 0 is a clean document; toxic ones are grade 1 or 2 by their rate of marking words against
    the median. Without both classes the model rejects nothing.
    """
    sample = (
        labels.select(F.col(doc_id).alias("id"), F.col(toxic).alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    )
    rows = kept(docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text")).join(F.broadcast(sample), "id"))

    def bags(known: frozenset | None = None) -> DataFrame:
        """Features of the sampled texts, one row each: all of them or those of a vocabulary."""

        def count(batches):
            for b in batches:
                got = [features(t.as_py()) for t in b.column("text")]
                if known is not None:
                    got = [({f: n for f, n in c.items() if f in known}, words) for c, words in got]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": b.column("id"),
                        "toxic": b.column("toxic").cast(pa.int64()),
                        "features": pa.array([list(f) for f, _ in got], pa.list_(pa.string())),
                        "counts": pa.array([list(f.values()) for f, _ in got], pa.list_(pa.int64())),
                        "words": pa.array([n for _, n in got], pa.int64()),
                    }
                )

        return rows.mapInArrow(count, f"id {docs.schema[doc_id].dataType.simpleString()}, toxic long, features array<string>, counts array<long>, words long")

    flat = bags().select("toxic", F.explode("features").alias("f"))
    # The share of toxic documents with a feature against that of all decides which ones are carried on.
    useful = flat.groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("k")).filter(F.col("k") >= MIN_DOCS)
    sizes = rows.agg(F.sum("toxic").alias("n1"), F.count("*").alias("n")).first()
    if not sizes["n1"] or sizes["n1"] == sizes["n"]:
        return Model()
    p1, p = F.col("a") / float(sizes["n1"]), F.col("k") / float(sizes["n"])
    picked = useful.withColumn("gain", F.abs(p1 - p) / F.sqrt(p * (1 - p) + 1e-9)).orderBy(F.desc("gain"), "f").limit(4 * max_features).select("f")
    # At most 4 * max_features words, so the texts are read again instead of being put together by a join.
    sampled = bags(frozenset(r["f"] for r in picked.collect()))
    sampled = sampled.select("id", "toxic", "words", "features", "counts", (F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(5)) == 0).alias("held"), F.lit(1).alias("one"))

    def one_fit(pdf: pd.DataFrame) -> pd.DataFrame:
        weights, cuts, reject, accuracy = _train(pdf.sort_values("id").reset_index(drop=True), max_features)
        return pd.DataFrame({"f": [list(weights)], "w": [list(weights.values())], "cuts": [cuts], "reject": [reject], "accuracy": [accuracy]})

    # One group of at most sample_docs rows.
    got = sampled.groupBy("one").applyInPandas(one_fit, "f array<string>, w array<double>, cuts array<double>, reject double, accuracy double").first()
    return Model(dict(zip(got["f"], got["w"])), list(got["cuts"]), got["reject"], got["accuracy"]) if got else Model()


def scored(docs: DataFrame, model: Model, text: str = "text", severity: str = "__severity", grade: str = "__grade") -> DataFrame:
    """All rows and columns of ``docs`` plus severity and grade. Null or empty text scores as no words.

    Columns of ``docs`` that have these two names are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in (severity.lower(), grade.lower())]

    def rate(texts: pd.Series) -> pd.DataFrame:
        s = np.array([model.score(t) if t else 0.0 for t in texts])
        return pd.DataFrame({"severity": model.severity(s), "grade": model.grade(s)})

    udf = F.pandas_udf(rate, "severity double, grade long")
    (both,) = free_names(docs, "__s")
    out = docs.select(*[F.col(f"`{c}`") for c in names], udf(F.col(text)).alias(both))
    return out.select(*[F.col(f"`{c}`") for c in names], F.col(both)["severity"].alias(severity), F.col(both)["grade"].alias(grade))


def is_toxic(model: Model, severity: str = "__severity") -> Column:
    return F.col(severity) >= F.lit(model.reject_from)


