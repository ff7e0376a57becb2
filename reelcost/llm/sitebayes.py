"""Document quality by hierarchical empirical Bayes.

A logistic classifier turns a text's shape into a probability. Sites come in two levels, host and
path. A host's mean is shrunk towards the corpus mean, a path's towards its host's; how strongly is
estimated from the spread between sites beyond what their sizes explain. A document's posterior odds
are its classifier's odds times the odds of its path, from which its own share is taken out, over
the corpus odds. Sites are grouped sums, so a site with a third of all rows costs nothing extra.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.sizing import join_stats
from .common import hashed_runs, hashed_words, kept, slices

SAMPLE_DOCS = 20_000
NAMES = ["log_words", "word_length", "marks", "upper", "digits", "foreign", "distinct", "stutter", "distinct_pairs"]
_CLASS = np.zeros((4, 256), dtype=np.uint8)
_CLASS[0, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = 1
_CLASS[1, 65:91] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, 128:] = 1


def shapes(texts: pa.Array) -> np.ndarray:
    """Shape features of each text, all 0 for null or empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    words, first = hashed_words(texts)
    pairs = hashed_runs(words, 2)
    out = np.zeros((len(texts), len(NAMES)))
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.as_buffer(), np.uint8)
        a, b = first[i], first[i + 1]
        n = b - a
        if not n:
            continue
        own = words[a:b]
        out[i, 0] = np.log1p(n)
        out[i, 1] = np.log(len(raw) / n)
        counts = np.bincount(raw, minlength=256)
        out[i, 2:6] = np.sqrt(_CLASS @ counts / len(raw))
        out[i, 6] = len(np.unique(own)) / n
        out[i, 7] = np.sqrt((own[1:] == own[:-1]).mean()) if n > 1 else 0.0
        out[i, 8] = len(np.unique(pairs[a : b - 1])) / (n - 1) if n > 1 else 1.0
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised columns: (mean, scale, weights with intercept last)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q) - F.log(1 - q)


def _strength(groups: DataFrame, prior: str) -> float:
    """Prior weight in documents: small if sites differ by more than their sizes explain."""
    noise = F.col(prior) * (1 - F.col(prior)) / F.col("n")
    r = groups.filter("n > 1").agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(prior), 2)).alias("v"), F.sum(F.col("n") * noise).alias("e"), F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))).alias("b")).first()
    if not r["w"]:
        return 1.0
    between = max((r["v"] - r["e"]) / r["w"], 1e-9)
    return float(min(max(r["b"] / r["w"] / between - 1, 1.0), 1e6))


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, path, document_p, host_p, path_p, quality_p, keep.

    The classifier is fitted on at most ``sample_docs`` labelled documents, those whose ids hash lowest;
    means and strengths of sites come from all documents. Null texts have the shape of empty ones, null
    hosts and paths are sites of their own. Without both classes every document_p is 0.5 and all are kept.
    """
    names = ["__x%d" % i for i in range(len(NAMES))]

    def shape(batches):
        for b in batches:
            for part in slices(b, "text"):
                x = shapes(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), part.column("path"), *[pa.array(x[:, i]) for i in range(x.shape[1])]], ["doc_id", "host", "path", *names])

    id_type = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias("text"))
    rows = kept(source.mapInArrow(shape, f"doc_id {id_type}, host string, path string, " + ", ".join(f"{n} double" for n in names)))
    sample = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    known = rows.join(F.broadcast(sample), "doc_id").select("doc_id", *names, "y").toPandas().sort_values("doc_id")  # at most sample_docs documents
    y = known["y"].to_numpy() if len(known) else np.empty(0)
    fitted = len(set(y)) == 2
    if fitted:
        mean, scale, w = fit_logistic(known[names].to_numpy(), y)
        total = F.lit(float(w[-1]))
        for n, m, s, c in zip(names, mean, scale, w):
            total = total + (F.col(n) - float(m)) / float(s) * float(c)
        p = 1 / (1 + F.exp(-total))
    else:
        p = F.lit(0.5)
    scored = rows.select("doc_id", "host", "path", p.alias("document_p"))
    paths = kept(scored.groupBy("host", "path").agg(F.sum("document_p").alias("s"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    sums = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mu = sums["s"] / sums["n"] if sums["n"] else 0.5
    k_host = _strength(hosts.withColumn("mu", F.lit(mu)), "mu")
    hosts = kept(hosts.select("host", ((k_host * mu + F.col("s")) / (k_host + F.col("n"))).alias("host_p")))
    paths = join_stats(paths, hosts, ["host"], null_safe=True)
    k_path = _strength(paths, "host_p")
    out = join_stats(scored, paths, ["host", "path"], null_safe=True)
    others = (k_path * F.col("host_p") + F.col("s") - F.col("document_p")) / (k_path + F.col("n") - 1)
    out = out.withColumn("path_p", (k_path * F.col("host_p") + F.col("s")) / (k_path + F.col("n")))
    odds = logit(F.col("document_p")) + logit(others) - logit(F.lit(mu))
    out = out.withColumn("quality_p", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "host", "path", "document_p", "host_p", "path_p", "quality_p", (F.col("quality_p") >= 0.5).alias("keep") if fitted else F.lit(True).alias("keep"))
