"""Exact duplicates by deterministic block naming.

A text without its white space is cut into blocks of a fixed size. Distinct blocks are sorted
and numbered; adjacent numbers are paired, distinct pairs are sorted and numbered again, until a
text has one number. Two texts have the same (level, number) exactly if they are equal.

Blocks are sorted by (64-bit hash, content): contents are compared wherever hashes agree, so a
hash that two contents share costs work, never a wrong answer, and block texts move once, after
map-side removal of repeats. All later levels sort pairs of integers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_names, kept, text_of

BLOCK_CHARS = 2048


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def _blocks(norm: Column, size: int) -> Column:
    parts = F.regexp_extract_all(norm, F.lit("(?s).{1,%d}" % size), F.lit(0))
    return F.when(norm == "", F.array(F.lit(""))).otherwise(parts)


def _key(block: Column, bits: int) -> Column:
    h = F.xxhash64(block)
    return h if bits >= 64 else F.pmod(h, F.lit(1 << bits))


def _numbered(df: DataFrame, *cols: str) -> DataFrame:
    """Sort distinct values and give each an integer from 1 on; kept, so that numbers never change."""
    return kept(df.select(*cols).distinct().sort(*cols).withColumn("name", F.monotonically_increasing_id() + 1))


def duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, n_chars, level, name.

    Null text counts as empty; empty texts equal each other. The longest original (code points)
    stays, then the smallest doc_id, null last; of fully equal rows one stays. An empty table gives
    an empty result. Other columns are not read. ``hash_bits`` is lowered in tests to force clashes.
    """
    raw = df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    norm = raw.select("doc_id", F.length("t").alias("n_chars"), normalised(F.col("t")).alias("norm"))
    cut = norm.select("doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), _blocks(F.col("norm"), block_chars).alias("blocks"))

    contents = cut.select(F.explode("blocks").alias("block")).select(_key(F.col("block"), hash_bits).alias("h"), "block").distinct()
    clash = kept(contents.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"))
    rid = cut.withColumn("rid", F.monotonically_increasing_id())
    if clash.isEmpty():
        rows = kept(rid.select("rid", "doc_id", "n_chars", "text_sha256", F.transform("blocks", lambda b: F.struct(_key(b, hash_bits).alias("h"), F.lit(0).alias("r"))).alias("keys")))
    else:
        w = Window.partitionBy("h").orderBy("block")
        ranks = contents.join(clash, "h").withColumn("r", F.row_number().over(w) - 1)
        flat = rid.select("*", F.posexplode("blocks").alias("i", "block")).drop("blocks").withColumn("h", _key(F.col("block"), hash_bits))
        flat = flat.join(ranks, ["h", "block"], "left")
        rows = kept(
            flat.groupBy("rid")
            .agg(
                *[F.first(c).alias(c) for c in ("doc_id", "n_chars", "text_sha256")],
                F.array_sort(F.collect_list(F.struct("i", "h", F.coalesce("r", F.lit(0)).alias("r")))).alias("a"),
            )
            .select("rid", "doc_id", "n_chars", "text_sha256", F.transform("a", lambda x: F.struct(x.h.alias("h"), x.r.alias("r"))).alias("keys"))
        )

    level = 0
    most = rows.agg(F.max(F.size("keys"))).first()[0] or 1
    flat = rows.select("rid", F.size("keys").alias("m"), F.posexplode("keys").alias("i", "k")).select("rid", "m", "i", "k.h", "k.r")
    current = kept(flat.join(_numbered(flat, "h", "r"), ["h", "r"]).select("rid", "m", "i", "name"))
    done = [current.filter("m = 1").select("rid", F.lit(0).alias("level"), "name")]
    for level in range(1, math.ceil(math.log2(most)) + 1):
        pairs = (
            current.filter("m > 1")
            .groupBy("rid", "m", (F.col("i") / 2).cast("int").alias("j"))
            .agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(0)).alias("r"))
        )
        pairs = kept(pairs)
        named = pairs.join(_numbered(pairs, "l", "r"), ["l", "r"])
        current = kept(named.select("rid", ((F.col("m") + 1) / 2).cast("int").alias("m"), F.col("j").alias("i"), "name"))
        done.append(current.filter("m = 1").select("rid", F.lit(level).alias("level"), "name"))

    identity = done[0]
    for d in done[1:]:
        identity = identity.union(d)
    whole = kept(rows.drop("keys").join(identity, "rid"))
    best = F.min(F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid")))
    groups = kept(whole.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")))
    return whole.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        "text_sha256",
        "n_chars",
        "level",
        "name",
    )


def without_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    key, chars, other, sha, n = free_names(df, "__key", "__len", "__id", "__sha", "__n")
    stays = duplicates(df, doc_id, text).filter("kept").select(F.col("doc_id").alias(other), F.col("text_sha256").alias(sha), F.col("n_chars").alias(n))
    marked = df.select("*", F.sha2(normalised(text_of(text)), 256).alias(key), F.length(text_of(text)).alias(chars))
    on = (F.col(key) == F.col(sha)) & F.col(doc_id).eqNullSafe(F.col(other)) & (F.col(chars) == F.col(n))
    return marked.join(stays, on).dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in df.columns])
