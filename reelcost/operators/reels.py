"""From minute rows to one row per reel, and repair of wrong grade numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.ordered import BLK, bounded_frames, with_blocks
from ..core.quantiles import group_medians
from ..core.sizing import block_count, join_stats, materialise
from ..functions.expr import truthy
from .relate import keep_first, second_last_rows, with_keys_of


def turnup_rows(
    df: DataFrame,
    measures: Sequence[str],
    averaged: Sequence[str] = (),
    option: str = "last",
    reel: str = "reel_id",
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """One row per reel: the second-to-last row, or medians, with chosen measures as reel means."""
    if option == "median":
        base = group_medians(df, [reel], {m: F.col(m) for m in measures})
    elif option == "last":
        base = second_last_rows(df, [reel], order)
    else:
        raise ValueError("option must be 'last' or 'median'")
    if not averaged:
        return base
    means = df.groupBy(reel).agg(*[F.avg(v).alias(f"__a_{v}") for v in averaged])
    joined = base.join(means, reel, "left")
    return joined.select(*[F.col(f"__a_{c}").alias(c) if c in averaged else F.col(c) for c in base.columns])


def split_turnup_continuous(
    df: DataFrame, turnup: DataFrame, quality: Sequence[str], reel: str = "reel_id", order: Sequence[str] = ("ts",)
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unique turn-ups (first per quality tuple), minute rows of those reels, and the dropped reels."""
    unique = keep_first(turnup, quality, [*order, reel])
    dropped = turnup.join(unique.select(reel), reel, "left_anti")
    return unique, with_keys_of(df, unique, [reel]), dropped


def snap_to_targets(value: str | Column, targets: Sequence[float], tolerance: float, fallback: str | Column) -> Column:
    """Nearest target within the tolerance (the first one on a tie), else the fallback."""
    v = F.col(value) if isinstance(value, str) else value
    other = F.col(fallback) if isinstance(fallback, str) else fallback
    options = F.array(*[F.struct(F.abs(v - t).alias("gap"), F.lit(i).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(targets)])
    best = F.array_min(options)
    return F.when(truthy(best["gap"] <= tolerance), best["t"]).otherwise(other.cast("double"))


def smooth_isolated(
    df: DataFrame, category: str, grammage: str, part: Sequence[str], order: Sequence[str], blocks: int | None = None
) -> DataFrame:
    """A category that differs from the previous one and from the grammage becomes the previous one.

    A block of rows gets the last category of the block before it.
    """
    blocked = _in_blocks(df, order, blocks)
    w = Window.partitionBy(*part, BLK).orderBy(*order)
    last = blocked.groupBy(*part, BLK).agg(F.max_by(category, F.struct(*order)).alias("__last"))
    carry = last.select(*part, BLK, F.lag("__last").over(Window.partitionBy(*part).orderBy(BLK)).alias("__c"))
    got = blocked.select("*", F.lag(category).over(w).alias("__p"), F.row_number().over(w).alias("__rn"))
    got = join_stats(got, carry, [*part, BLK], null_safe=True).withColumn("__p", F.when(F.col("__rn") == 1, F.col("__c")).otherwise(F.col("__p")))
    c = F.col(category)
    lone = truthy(F.col("__p").isNotNull() & (c != F.col("__p"))) & truthy(c != F.col(grammage))
    done = got.withColumn(category, F.when(lone, F.col("__p")).otherwise(c)).select(*df.columns, BLK)
    out = done.drop(BLK)
    # The next ordered step on this very table goes on with its blocks instead of sorting the rows again.
    out._in_blocks = (list(order), done)
    return out


def _in_blocks(df: DataFrame, order: Sequence[str], blocks: int | None) -> DataFrame:
    """Rows with their block along ``order``: at least ``blocks`` of them, more when the table needs more."""
    known = getattr(df, "_in_blocks", None)
    if known and known[0] == list(order):
        return known[1]
    return with_blocks(df, order, max(blocks or 1, block_count(df)))


def mismatch_runs(
    df: DataFrame, category: str, grammage: str, part: Sequence[str], order: Sequence[str], blocks: int | None = None
) -> DataFrame:
    """Mismatch flag, batch start, and length and position in the run of equal flags.

    A run is a range of row numbers. A block knows where runs begin inside it; one row a block then tells the number of
    rows before it, the begin of the run that reaches into it and the end of the one that reaches out of it.
    """
    blocked = _in_blocks(df, order, blocks).withColumn("mismatch", ~F.col(category).eqNullSafe(F.col(grammage).cast("double")))
    w = Window.partitionBy(*part, BLK).orderBy(*order)
    marked = blocked.select("*", F.row_number().over(w).cast("long").alias("__rn"), F.lag("mismatch").over(w).alias("__pm"), F.lag(grammage).over(w).alias("__pg"))
    turn = (F.col("__rn") > 1) & ~F.col("mismatch").eqNullSafe(F.col("__pm"))
    ends = marked.groupBy(*part, BLK).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(turn, F.col("__rn"))).alias("t1"), F.max(F.when(turn, F.col("__rn"))).alias("t2"),
        F.max(F.when(F.col("__rn") == 1, F.col("mismatch"))).alias("first"), F.max_by(F.struct("mismatch", F.col(grammage).alias("g")), "__rn").alias("last"),
    )
    along = Window.partitionBy(*part).orderBy(BLK)
    before, behind = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*part).orderBy(F.desc(BLK)).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        "*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"), F.lag("last").over(along).alias("__prev"), F.sum("n").over(Window.partitionBy(*part)).alias("__all"),
        F.lag(F.lit(1)).over(along).isNull().alias("__top"),
    )
    ends = ends.withColumn("__new", ~F.col("first").eqNullSafe(F.col("__prev.mismatch")))
    at = F.col("__before")
    opened, closed = F.when(F.col("__new"), at + 1).otherwise(at + F.col("t1")), at + F.coalesce("t2", F.when(F.col("__new"), 1))
    ends = ends.select(
        *part, BLK, "__before", "__top", "__new", F.col("__prev.g").alias("__g"),
        F.last(closed, ignorenulls=True).over(before).alias("__a0"), F.coalesce(F.last(opened, ignorenulls=True).over(behind), F.col("__all") + 1).alias("__z0"),
    )
    got = join_stats(marked, ends, [*part, BLK], null_safe=True).withColumn("__at", F.col("__before") + F.col("__rn"))
    first = F.col("__rn") == 1
    start = F.when(F.when(first, F.col("__new")).otherwise(turn), F.col("__at"))
    got = got.select("*", start.alias("__s"), F.max(start).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__a"))
    rest = Window.partitionBy(*part, BLK).orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, -1)
    got = got.select("*", F.min("__s").over(rest).alias("__z"))
    a, z, zero = F.coalesce("__a", "__a0"), F.coalesce("__z", "__z0"), F.lit(0).cast("long")
    return got.select(
        *df.columns,
        "mismatch",
        (~F.col(grammage).eqNullSafe(F.when(first, F.col("__g")).otherwise(F.col("__pg"))) | (first & F.col("__top"))).alias("new_batch"),
        F.when(F.col("mismatch"), z - a).otherwise(zero).alias("run_length"),
        F.when(F.col("mismatch"), F.col("__at") - a + 1).otherwise(zero).alias("run_pos"),
    )


def grammage_check(persist_n: int = 3) -> Column:
    """Class of a row from its mismatch run."""
    return (
        F.when(~F.col("mismatch"), "match")
        .when(F.col("new_batch") & (F.col("run_pos") == 1), "batch_start_ok")
        .when(F.col("run_length") >= persist_n, "grammage_wrong")
        .otherwise("check")
    )


def repair_grade_ids(
    df: DataFrame, wrong: Column, target: str, order: Sequence[str], grade: str = "grade_id", prefix: int = 4, known: DataFrame | None = None
) -> DataFrame:
    """Replace the last three digits of wrong grade ids by the target grammage.

    A known grade with the same prefix comes first, then any known grade with that ending
    (both in order of first appearance), else the digits are put together. ``known`` gives the same grades and order
    columns where ``df`` is costly to read.
    """
    source = df if known is None else known
    seen = materialise(source.filter(F.length(grade) >= 3).groupBy(F.col(grade).alias("__g")).agg(F.min(F.struct(*order)).alias("__first")))
    tail, head = F.substring("__g", -3, 3), F.substring("__g", 1, prefix)
    same = seen.groupBy(head.alias("__h"), tail.alias("__t")).agg(F.min_by("__g", "__first").alias("__same"))
    any_ = seen.groupBy(tail.alias("__t")).agg(F.min_by("__g", "__first").alias("__any"))
    wanted = F.lpad(F.col(target).cast("int").cast("string"), 3, "0")
    rows = df.withColumns({"__bad": truthy(wrong), "__t": wanted, "__h": F.substring(grade, 1, prefix)})
    rows = join_stats(rows, same, ["__h", "__t"])
    rows = join_stats(rows, any_, ["__t"])
    stem = F.when(F.length(grade) >= 3, F.expr(f"left({grade}, length({grade}) - 3)")).otherwise("")
    made = F.coalesce("__same", "__any", F.concat(stem, F.col("__t")))
    usable = F.col("__bad") & F.col(grade).isNotNull() & F.col(target).isNotNull()
    return rows.select(*[F.when(usable, made).otherwise(F.col(grade)).alias(grade) if c == grade else F.col(c) for c in df.columns])


def repair_grammage(
    df: DataFrame,
    basis_weight: str,
    grammage: str,
    targets: Sequence[float],
    part: Sequence[str],
    order: Sequence[str],
    tolerance: float = 4.5,
    persist_n: int = 3,
    fix_batch_start: bool = False,
    grade: str = "grade_id",
    blocks: int | None = None,
) -> DataFrame:
    """Snap the basis weight, smooth, classify mismatches and repair grade id and grammage."""
    snapped = df.withColumn("basis_weight_cat", snap_to_targets(basis_weight, targets, tolerance, grammage))
    smooth = smooth_isolated(snapped, "basis_weight_cat", grammage, part, order, blocks)
    runs = mismatch_runs(smooth, "basis_weight_cat", grammage, part, order, blocks)
    checked = runs.withColumn("grammage_check", grammage_check(persist_n))
    classes = ["grammage_wrong", "batch_start_ok"] if fix_batch_start else ["grammage_wrong"]
    wrong = F.col("grammage_check").isin(classes)
    fixed = repair_grade_ids(checked, wrong, "basis_weight_cat", order, grade, known=df)
    return fixed.withColumn(grammage, F.when(wrong, F.col("basis_weight_cat").cast("int")).otherwise(F.col(grammage)))


def break_edges(
    df: DataFrame, code: str, power: str, reel: str, part: Sequence[str], order: Sequence[str], level: float = 50.0, blocks: int | None = None
) -> DataFrame:
    """Reels with a break edge: the code falls to zero, or the power drops below the level next."""

    def exprs(w):
        return {"__prev": F.lag(code).over(w), "__next": F.lead(power).over(w)}

    got = bounded_frames(df, part, order, 1, 1, exprs, blocks)
    falls = truthy((F.col(code) == 0) & (F.col("__prev") != 0))
    drops = truthy((F.col(power) > level) & (F.col("__next") < level))
    return got.filter(falls | drops).select(reel).distinct()


def keep_at_transitions(
    df: DataFrame, measures: Sequence[str], reel: str, part: Sequence[str], order: Sequence[str], blocks: int | None = None
) -> DataFrame:
    """Keep measures only on the last row of a reel; the last row of all counts as one."""
    got = bounded_frames(df, part, order, 0, 1, lambda w: {"__n": F.lead(reel).over(w)}, blocks)
    last = ~F.col(reel).eqNullSafe(F.col("__n")) | F.col("__n").isNull()
    return got.select(*[F.when(last, F.col(c)).alias(c) if c in measures else F.col(c) for c in df.columns])


def change_point_nulling(
    df: DataFrame, measure: str, grade: str, part: Sequence[str], order: Sequence[str], blocks: int | None = None
) -> DataFrame:
    """At a grade change, null a value that is closer to the last but one than to the next value."""

    def exprs(w):
        return {
            "__g": F.lag(grade).over(w),
            "__first": F.lag(F.lit(1)).over(w).isNull(),
            "__b2": F.lag(measure, 2).over(w),
            "__n": F.lead(measure).over(w),
        }

    got = bounded_frames(df, part, order, 2, 1, exprs, blocks)
    changed = F.col("__first") | ~F.col(grade).eqNullSafe(F.col("__g"))
    near = truthy(F.abs(F.col(measure) - F.col("__b2")) < F.abs(F.col(measure) - F.col("__n")))
    return got.withColumn(measure, F.when(~(changed & near), F.col(measure))).select(*df.columns)

