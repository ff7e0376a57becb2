"""URL filter: rules first, then a ratio of two character language models.

URLs that a rule decides are the training texts of an accepted and a rejected model. Both are
variable-order Markov models over characters with Witten-Bell smoothing: p(c | context) mixes a
context's own counts with the next shorter context, down to a uniform distribution. A URL's score is
the log-likelihood difference divided by its length; the threshold is calibrated on held-out URLs,
by a model of the others.

Counts of the scoring model cover every ruled URL. Windows of ORDER + 1 characters are scored once each, by joins on
their contexts, and joined back to the URLs; contexts of at most one character, which every window
shares, are a bounded broadcast (one row per character).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

ORDER = 5
START = "\x02"
ALPHABET = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HELD_OUT = 5  # one in so many ruled URLs calibrates and is not counted for that


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path): both empty for null or without "://"."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(u, "(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(u, "(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(host, UPPER, LOWER), path


def _ruled(rules: list[Rule]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _windows(text: Column, order: int) -> Column:
    """For each character the (up to) ``order`` characters before it and itself; START marks the beginning."""
    s = F.concat(F.lit(START), text)
    places = F.sequence(F.lit(2), F.length(s))
    return F.when(F.length(text) > 0, F.transform(places, lambda i: F.substring(s, F.greatest(F.lit(1), i - order), F.least(i, F.lit(order + 1))))).otherwise(F.array().cast("array<string>"))


def _suffixes(window: Column) -> Column:
    """(context, next character) of every order."""
    n = F.length(window)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("k"), F.substring(window, n - k, k).alias("ctx"), F.substring(window, n, F.lit(1)).alias("c")))


def _model(training: DataFrame, order: int) -> DataFrame:
    """Per context: totals, distinct followers and the followers' counts, for both classes."""
    grams = training.select("accepted", F.explode(_windows(F.col("url"), order)).alias("w")).groupBy("w").agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.count("*").alias("n"))
    flat = grams.select("a", "n", F.explode(_suffixes(F.col("w"))).alias("s")).groupBy("s.ctx", "s.c").agg(F.sum("a").alias("a"), F.sum(F.col("n") - F.col("a")).alias("r"))
    follow = F.map_from_entries(F.collect_list(F.struct("c", F.struct("a", "r"))))
    return flat.groupBy("ctx").agg(
        F.sum("a").alias("na"), F.sum("r").alias("nr"), F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("r") > 0).cast("long")).alias("tr"), follow.alias("follow")
    )


def _window_scores(windows: DataFrame, model: DataFrame) -> DataFrame:
    """log p(c | accepted) - log p(c | rejected) of each distinct window."""
    low = F.broadcast(model.filter(F.length("ctx") <= 1))  # at most one row per character and the empty context
    high = model.filter(F.length("ctx") > 1)
    flat = windows.select("w", F.explode(_suffixes(F.col("w"))).alias("s")).select("w", "s.*")
    count = F.element_at("follow", F.col("c"))
    row = F.struct("k", "na", "nr", "ta", "tr", F.coalesce(count.a, F.lit(0)).alias("a"), F.coalesce(count.r, F.lit(0)).alias("r"))
    found = flat.filter("k <= 1").join(low, "ctx").select("w", row.alias("o")).union(flat.filter("k > 1").join(high, "ctx").select("w", row.alias("o")))
    orders = found.groupBy("w").agg(F.array_sort(F.collect_list("o")).alias("o"))

    def smoothed(p: Column, hits: Column, total: Column, kinds: Column) -> Column:
        return F.when(total > 0, (hits + kinds * p) / (total + kinds)).otherwise(p)

    start = F.struct(F.lit(1.0 / ALPHABET).alias("pa"), F.lit(1.0 / ALPHABET).alias("pr"))
    fold = F.aggregate("o", start, lambda s, o: F.struct(smoothed(s.pa, o.a, o.na, o.ta).alias("pa"), smoothed(s.pr, o.r, o.nr, o.tr).alias("pr")), lambda s: F.log(s.pa) - F.log(s.pr))
    return orders.select("w", fold.alias("score"))


def _scored(urls: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(url, score) of distinct URLs; a window without any known context counts 0."""
    flat = kept(urls.select("url", F.explode(_windows(F.col("url"), order)).alias("w")))
    known = kept(_window_scores(flat.select("w").distinct(), model))
    joined = flat.join(known, "w", "left")
    return joined.groupBy("url").agg((F.sum(F.coalesce("score", F.lit(0.0))) / F.count("*")).alias("score"))


def _threshold(scores: DataFrame) -> float:
    """Lowest sum of both error shares on held-out URLs, from counts per hundredth of a nat."""
    bins = scores.groupBy(F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) * 100).alias("b")).agg(
        F.sum(F.col("accepted").cast("long")).alias("a"), F.count("*").alias("n")
    )
    rows = sorted((r["b"], r["a"], r["n"] - r["a"]) for r in bins.collect())  # at most 4,001 rows
    total_a, total_r = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not total_a or not total_r:
        return 0.0
    best, found, lost, caught = 2.0, 0.0, 0, 0
    for i, (b, a, r) in enumerate(rows):
        lost, caught = lost + a, caught + r
        error = lost / total_a + 1 - caught / total_r
        if error < best:
            upper = rows[i + 1][0] if i + 1 < len(rows) else b + 1
            best, found = error, (b + 1 + upper) / 200
    return found


def judged(df: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", order: int = ORDER) -> DataFrame:
    """One row per row of ``df``: page_id, host, path, rule, verdict, score (null where a rule decides).

    A null or empty URL scores 0. Without both kinds of ruled URLs the threshold is 0 and all scores
    are equal to it or follow the one model there is; a score at the threshold or above is allowed.
    """
    host, path = parts("url")
    rows = df.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    rows = rows.select("*", host.alias("host"), path.alias("path")).withColumn("found", _ruled(rules))
    ruled = rows.filter("found is not null").select("url", (F.col("found.verdict") == "allow").alias("accepted")).withColumn("held", F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0)
    tuning = kept(ruled.filter("held").select("url", "accepted").distinct())
    calibrating = kept(_model(ruled.filter("not held").select("url", "accepted"), order))
    threshold = _threshold(_scored(tuning.select("url"), calibrating, order).join(tuning, "url"))
    model = kept(_model(ruled.select("url", "accepted"), order))
    mine = kept(_scored(rows.filter("found is null").select("url").distinct(), model, order)).withColumnRenamed("score", "s")
    out = rows.join(mine, "url", "left")
    score = F.when(F.col("found").isNull(), F.coalesce("s", F.lit(0.0)))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.coalesce("s", F.lit(0.0)) >= threshold, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))
