"""Ordered-window work that does not put one huge key into one task.

A window over a machine or a grade would sort all rows of that key in one task. Here the rows
of a key are cut into blocks along the order column. Each block is handled by its own task and
gets what it needs from its neighbours: a small carry row (running sums, fills), or copies of
a few boundary rows (bounded frames).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sizing import block_count, join_stats

BLK = "__blk"
# Rows of one block in the row-number based layout.
BLOCK_ROWS = 1_000_000
_SUB = 100_000


def order_number(df: DataFrame, col: str) -> Column:
    """Numeric image of an order column that keeps its order."""
    t = df.schema[col].dataType
    if isinstance(t, T.TimestampType):
        return F.unix_micros(F.col(col)).cast("double")
    if isinstance(t, T.DateType):
        return F.unix_date(F.col(col)).cast("double")
    return F.col(col).cast("double")


def with_blocks(df: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Add a block number that never decreases along ``order``.

    Split points come from one approximate-quantile job over the first order column and are
    literals from then on, so a recomputed task sees the same blocks. A value that fills
    several blocks by itself is split further by the second order column, which must be
    numeric for that.
    """
    n = blocks or block_count(df)
    if n <= 1:
        return df.withColumn(BLK, F.lit(0).cast("long"))
    key = F.coalesce(order_number(df, order[0]), F.lit(float("-inf")))
    keyed = df.withColumn("__key", key)
    finite = keyed.select("__key").filter(F.col("__key") > float("-inf"))
    found = finite.approxQuantile("__key", [i / n for i in range(1, n)], 0.2 / n)
    repeats: dict[float, int] = {}
    for v in found:
        repeats[v] = repeats.get(v, 0) + 1
    splits = sorted(repeats)
    if not splits:
        return df.withColumn(BLK, F.lit(0).cast("long"))
    hot = {v: k for v, k in repeats.items() if k > 1}
    bucketed = Bucketizer(
        splits=[float("-inf"), *splits, float("inf")], inputCol="__key", outputCol="__bucket", handleInvalid="keep"
    ).transform(keyed)
    sub = F.lit(0).cast("long")
    if hot and len(order) > 1:
        tie = order_number(df, order[1])
        fan = max(hot.values()) + 1
        cuts = (
            keyed.filter(F.col("__key").isin(list(hot)))
            .groupBy("__key")
            .agg(F.percentile_approx(tie, [i / fan for i in range(1, fan)], 1000).alias("cuts"))
            .collect()
        )
        table = {r["__key"]: sorted(set(r["cuts"])) for r in cuts}
        lookup = F.create_map(
            *[x for v, c in table.items() for x in (F.lit(v), F.array(*[F.lit(float(y)) for y in c]))]
        )
        inner = F.size(F.filter(lookup[F.col("__key")], lambda s: s <= tie)).cast("long")
        # Rows after a hot value share its bucket and must come behind all its parts.
        sub = F.when(F.col("__key").isin(list(table)), inner).otherwise(F.lit(_SUB - 1).cast("long"))
    return bucketed.withColumn(BLK, F.col("__bucket").cast("long") * _SUB + sub).drop("__key", "__bucket")


def _spec(part: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*part).orderBy(*order)


def _carry(blocked: DataFrame, part: Sequence[str], aggs, carried) -> DataFrame:
    """Per-block aggregates, then values carried across the blocks of a key (few rows)."""
    summary = blocked.groupBy(*part, BLK).agg(*aggs)
    return summary.select(*part, BLK, *carried)


def running_sums(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    blocks: int | None = None,
) -> DataFrame:
    """Add ``{alias: running sum}`` per key, current row included."""
    blocked = with_blocks(df, order, blocks)
    names = list(sums)
    blocked = blocked.select("*", *[F.coalesce(c, F.lit(0)).alias(f"__x_{a}") for a, c in sums.items()])
    w = _spec([*part, BLK], order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select("*", *[F.sum(f"__x_{a}").over(w).alias(a) for a in names])
    out_cols = [*df.columns, *names]
    if (blocks or block_count(df)) <= 1:
        return local.select(*out_cols)
    before = Window.partitionBy(*part).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = _carry(
        blocked,
        part,
        [F.sum(f"__x_{a}").alias(f"__s_{a}") for a in names],
        [F.coalesce(F.sum(f"__s_{a}").over(before), F.lit(0)).alias(f"__c_{a}") for a in names],
    )
    joined = join_stats(local, carry, [*part, BLK], null_safe=True)
    return joined.select(*df.columns, *[(F.col(a) + F.col(f"__c_{a}")).alias(a) for a in names])


def row_index(
    df: DataFrame, part: Sequence[str], order: Sequence[str], name: str = "rn", blocks: int | None = None
) -> DataFrame:
    """Consecutive row number per key, from 1."""
    return running_sums(df, part, order, {name: F.lit(1).cast("long")}, blocks)


def neighbours(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    last: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Last non-null value up to a row (``last``) and first one from it on (``following``)."""
    last, following = last or {}, following or {}
    blocked = with_blocks(df, order, blocks)
    blocked = blocked.select(
        "*",
        *[c.alias(f"__l_{a}") for a, c in last.items()],
        *[c.alias(f"__f_{a}") for a, c in following.items()],
    )
    # A frame that ends at the last row is recomputed for every row; the reversed order makes it a running one.
    running = (Window.unboundedPreceding, 0)
    back = _spec([*part, BLK], order).rowsBetween(*running)
    ahead = Window.partitionBy(*part, BLK).orderBy(*[F.desc(o) for o in order]).rowsBetween(*running)
    local = blocked.select(
        "*",
        *[F.last(f"__l_{a}", ignorenulls=True).over(back).alias(a) for a in last],
        *[F.last(f"__f_{a}", ignorenulls=True).over(ahead).alias(a) for a in following],
    )
    names = [*last, *following]
    if (blocks or block_count(df)) <= 1:
        return local.select(*df.columns, *names)
    key = F.struct(*[F.col(o) for o in order])
    prev = Window.partitionBy(*part).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    nxt = Window.partitionBy(*part).orderBy(F.desc(BLK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = _carry(
        blocked,
        part,
        [F.max_by(f"__l_{a}", F.when(F.col(f"__l_{a}").isNotNull(), key)).alias(f"__s_{a}") for a in last]
        + [F.min_by(f"__f_{a}", F.when(F.col(f"__f_{a}").isNotNull(), key)).alias(f"__s_{a}") for a in following],
        [F.last(f"__s_{a}", ignorenulls=True).over(prev).alias(f"__c_{a}") for a in last]
        + [F.last(f"__s_{a}", ignorenulls=True).over(nxt).alias(f"__c_{a}") for a in following],
    )
    joined = join_stats(local, carry, [*part, BLK], null_safe=True)
    return joined.select(*df.columns, *[F.coalesce(F.col(a), F.col(f"__c_{a}")).alias(a) for a in names])


def bounded_frames(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    exprs: Callable[[WindowSpec], Mapping[str, Column]],
    blocks: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Window expressions that look at most ``before`` rows back and ``after`` rows ahead.

    ``exprs`` receives the ordered window and may use ``lag``, ``lead`` or a row frame inside
    the stated reach. On large inputs rows get a global index, are cut every ``block_rows``
    rows, and boundary rows are copied to the neighbouring block.
    """
    n = blocks or block_count(df)
    if n <= 1:
        made = exprs(_spec(part, order))
        return df.select("*", *[c.alias(a) for a, c in made.items()])
    if before > block_rows or after > block_rows:
        raise ValueError("the frame must not be longer than a block")
    numbered = row_index(df, part, order, "__rn", n)
    own = F.floor((F.col("__rn") - 1) / block_rows)
    pos = F.pmod(F.col("__rn") - 1, F.lit(block_rows))
    targets = F.filter(
        F.array(
            own,
            F.when(pos >= block_rows - before, own + 1) if before else F.lit(None).cast("long"),
            F.when(pos < after, own - 1) if after else F.lit(None).cast("long"),
        ),
        lambda b: b.isNotNull(),
    )
    copied = numbered.withColumn("__own", own).select("*", F.explode(targets).alias("__at"))
    made = exprs(Window.partitionBy(*part, "__at").orderBy("__rn"))
    done = copied.select("*", *[c.alias(a) for a, c in made.items()])
    return done.filter(F.col("__own") == F.col("__at")).select(*df.columns, *made)


def time_frames(
    df: DataFrame,
    part: Sequence[str],
    ts: str,
    width_seconds: int,
    exprs: Callable[[WindowSpec], Mapping[str, Column]],
    blocks: int | None = None,
) -> DataFrame:
    """Trailing ``(t - width, t]`` frames; each time slice also gets the slice before it."""
    micros = F.unix_micros(F.col(ts))
    width = width_seconds * 1_000_000
    if (blocks or block_count(df)) <= 1:
        w = Window.partitionBy(*part).orderBy(micros).rangeBetween(-width + 1, 0)
        return df.select("*", *[c.alias(a) for a, c in exprs(w).items()])
    own = F.floor(micros / width)
    copied = df.withColumn("__own", own).select("*", F.explode(F.array(own, own + 1)).alias("__at"))
    w = Window.partitionBy(*part, "__at").orderBy(micros).rangeBetween(-width + 1, 0)
    made = exprs(w)
    done = copied.select("*", *[c.alias(a) for a, c in made.items()])
    return done.filter(F.col("__own") == F.col("__at")).select(*df.columns, *made)


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows per key. Spark trims each key on the map side before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k)
    return kept.withColumnRenamed("__rank", rank) if rank else kept.drop("__rank")
