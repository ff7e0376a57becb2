"""Secrets in texts: base patterns, and weak candidates that complementary parts confirm.

A weak part alone (an account name, an endpoint, a bare random token, a short key) is no secret.
Parts are linked within scopes: a weak candidate is reported only if parts of other roles stand
within SCOPE code points of it (from the end of the earlier part to the start of the later), which together with it make up a usable credential. The link is
an interval join on (document, scope bucket); per bucket and role only the outermost positions
take part, so a document full of parts does not multiply.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

SCOPE = 200
# Fixed patterns of the base scan. "+" with a length test is kept where it decides what is consumed.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "identity", "material", "endpoint"]
# Weak parts by role. A role is confirmed by the roles named beside it.
IDENTITY = re.compile(r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII)
MATERIAL = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
URL_REST = re.compile(r"""://[^\s"'<>]{3,}""")
URL_SCHEME = re.compile(r"[a-z][a-z0-9+.-]{1,15}$")
HOST = re.compile(r"""(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]{2,5})?""", re.ASCII)
CONFIRMS = {"identity": ("assign", "hex", "material"), "material": ("identity", "endpoint", "access"), "endpoint": ("assign", "access", "hex")}


def _may_assign(text: str) -> bool:
    """Every pattern with a separator needs one of these two characters."""
    return ":" in text or "=" in text


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if _may_assign(text) else []
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _random_looking(token: str) -> bool:
    return any("0" <= c <= "9" for c in token) and any("a" <= c <= "z" for c in token) and any("A" <= c <= "Z" for c in token)


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak candidates that don't overlap a base span."""
    out = [("material", *m.span()) for m in MATERIAL.finditer(text) if _random_looking(m[0])]
    if _may_assign(text):
        out += [("identity", *m.span()) for m in IDENTITY.finditer(text)]
        out += [("endpoint", *m.span()) for m in HOST.finditer(text)]
        for m in URL_REST.finditer(text):
            if scheme := URL_SCHEME.search(text[max(0, m.start() - 16) : m.start()]):
                out.append(("endpoint", m.start() - len(scheme[0]), m.end()))
    starts = sorted((s, e) for _, s, e in base)
    reach, most = [], 0
    for _, e in starts:
        reach.append(most := max(most, e))

    def free(s: int, e: int) -> bool:
        i = bisect_left(starts, (e, 0))
        return i == 0 or reach[i - 1] <= s

    return [(k, s, e) for k, s, e in out if free(s, e)]


def confirmed(base: list[tuple[str, int, int]], weak: list[tuple[str, int, int]], scope: int = SCOPE) -> list[tuple[str, int, int]]:
    """The weak candidates of one text that have a complementary part within ``scope``."""
    places = {k: sorted((s, e) for kind, s, e in base + weak if kind == k) for k in KINDS}
    reach = {k: list(accumulate((e for _, e in v), max)) for k, v in places.items()}

    def near(kind: str, start: int, end: int) -> bool:
        i = bisect_left(places[kind], (end + scope + 1,))
        return i > 0 and reach[kind][i - 1] >= start - scope

    return [w for w in weak if any(near(k, w[1], w[2]) for k in CONFIRMS[w[0]])]


def _span_text(spans: Column) -> Column:
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("a"), rank[s.kind].alias("b"), s.end.alias("c"), s.kind.alias("k"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s.k, s.a, s.c)), ",")


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``df``: rid, doc_id, base spans, and all spans after linking.

    A span is (kind, start, end) in code points. Null or empty text has none. Repeated rows are
    scanned each; other columns are not read.
    """

    def find(batches):
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            base, weak = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                found = base_spans(t)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                weak.append([dict(zip(("kind", "start", "end"), s)) for s in weak_spans(t, found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(span)), pa.array(weak, pa.list_(span))], ["doc_id", "base", "weak"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    id_type = df.schema[doc_id].dataType.simpleString()
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = kept(source.mapInArrow(find, f"doc_id {id_type}, base {span}, weak {span}").withColumn("rid", F.monotonically_increasing_id()))

    parts = found.filter(F.size("weak") > 0).select("rid", F.explode(F.concat("base", "weak")).alias("p")).select("rid", "p.*")
    # A part counts in every bucket that it reaches into, with its piece there; a candidate looks into all
    # buckets of its own range widened by the scope, of which only the outer two are not all within it.
    bucket = lambda at: F.floor(at / scope)
    pieces = parts.withColumn("b", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    piece = F.greatest("start", F.col("b") * scope), F.least("end", (F.col("b") + 1) * scope)
    seen = pieces.groupBy("rid", "b", F.col("kind").alias("other")).agg(F.min(piece[0]).alias("first"), F.max(piece[1]).alias("last"))
    weak = parts.filter(F.col("kind").isin(list(CONFIRMS))).withColumn("b", F.explode(F.sequence(bucket(F.col("start") - scope), bucket(F.col("end") + scope))))
    near = (F.col("last") >= F.col("start") - scope) & (F.col("first") <= F.col("end") + scope)
    fits = F.lit(False)
    for kind, others in CONFIRMS.items():
        fits = fits | ((F.col("kind") == kind) & F.col("other").isin(list(others)))
    linked = weak.join(seen, ["rid", "b"]).filter(near & fits).select("rid", "kind", "start", "end").distinct()
    added = linked.groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    return found.join(added, "rid", "left").select("rid", "doc_id", "base", F.concat("base", F.coalesce("added", F.array().cast(span))).alias("spans"))


def _of_kind(kind: str):
    return lambda s: s.kind == kind


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base kinds, a hash of the base spans and all spans, per document."""
    found = scan(df, doc_id, text)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_span_text(F.col("base")), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))


def redacted(df: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """All rows and columns of ``df`` with every reported span replaced by ``mark``; n_chars follows if present.

    Spans are the same as those of ``scan``, but found and confirmed text by text, so texts are not shuffled.
    """

    def clean(texts):
        import pandas as pd

        def one(t):
            if not t:
                return t
            base = base_spans(t)
            weak = weak_spans(t, base)
            spans = base + confirmed(base, weak)
            out, at = [], 0
            for s, e in sorted((s, e) for _, s, e in spans):
                if e <= at:
                    continue
                if s >= at:
                    out += [t[at:s], mark]
                at = e
            return "".join(out) + t[at:]

        return pd.Series([one(t) for t in texts], dtype=object)

    changed = df.withColumn(text, F.pandas_udf(clean, "string")(F.col(text)))
    return changed.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else changed
