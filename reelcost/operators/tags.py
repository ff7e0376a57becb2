"""Sensor tag series, tag dictionaries and table summaries."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.ordered import row_index, top_rows
from ..core.sizing import join_stats
from ..functions.expr import SENTINEL, finite


def explode_series(series: DataFrame, tag="TagName", times="TimeStamp", values="Value", unit="Units") -> DataFrame:
    """Arrays of one tag per row to long rows (ts, tag, value, unit)."""
    zipped = F.arrays_zip(F.col(times).alias("ts"), F.col(values).alias("value"))
    flat = series.select(F.col(tag).alias("tag"), F.col(unit).alias("unit"), F.explode(zipped).alias("p"))
    return flat.select("p.ts", "tag", "p.value", "unit")


def series_to_wide(long: DataFrame, tags: Sequence[str], ts="ts", tag="tag", value="value", order: str | None = None) -> DataFrame:
    """One row per time and one column per known tag, in the order of ``tags``.

    Of several values for one time and tag the latest by ``order`` counts.
    """
    pick = lambda t: F.when(F.col(tag) == t, F.col(value))
    if order is None:
        aggs = [F.first(pick(t), ignorenulls=True).alias(t) for t in tags]
    else:
        aggs = [F.max_by(F.col(value), F.when(F.col(tag) == t, F.col(order))).alias(t) for t in tags]
    return long.filter(F.col(tag).isin(list(tags))).groupBy(ts).agg(*aggs)


def tag_units(long: DataFrame, tag="tag", unit="unit") -> DataFrame:
    return long.select(tag, unit).distinct()


def rename_tags(df: DataFrame, dictionary: DataFrame, ts: str, ts_name: str = "Wedge Time") -> DataFrame:
    """Wide table: keep tags with a number in the dictionary, rename them, drop infinities.

    The dictionary is matched against the column names, so only rows of existing tags are fetched.
    """
    found = dictionary.filter(F.col("TagNumber").isNotNull() & F.col("Tags").isin([c for c in df.columns if c != ts]))
    names = {r["Tags"]: r["Name"] for r in found.select("Tags", "Name").distinct().collect()}
    double = (T.DoubleType, T.FloatType)
    cols = [
        (finite(f"`{f.name}`") if isinstance(f.dataType, double) else F.col(f"`{f.name}`")).alias(names[f.name])
        for f in df.schema.fields
        if f.name in names
    ]
    return df.select(F.col(ts).alias(ts_name), *cols)


def rename_tags_long(long: DataFrame, dictionary: DataFrame, tag="tag", value="value") -> DataFrame:
    """Long table: inner lookup of the tag name; unknown tags and unnumbered entries go away."""
    known = dictionary.filter(F.col("TagNumber").isNotNull()).select(F.col("Tags").alias(tag), F.col("Name").alias("name"))
    return join_stats(long.withColumn(value, finite(value)), known, [tag], how="inner")


def align_columns(df: DataFrame, glossary: DataFrame, drop: Sequence[str], feature: str = "Feature") -> DataFrame:
    """Columns that the glossary lists and the drop list does not, in the order of the table."""
    wanted = glossary.filter(F.col(feature).isin(df.columns) & ~F.col(feature).isin(list(drop)))
    names = {r[0] for r in wanted.select(feature).distinct().collect()}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in names])


def glossary_features(glossary: DataFrame, drop: DataFrame, feature: str = "Feature") -> DataFrame:
    return glossary.join(drop.select(feature), feature, "left_anti")


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r"[\[\]<>]", "_", c).replace(" ", "_") for c in df.columns])


def upsert_latest(current: DataFrame, incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """Append rows and keep the newest per key."""
    both = current.unionByName(incoming, allowMissingColumns=True)
    return top_rows(both, [key], [F.desc(seq)])


def unique_labels(df: DataFrame, label: str, order: Sequence[str], out: str = "unique_label") -> DataFrame:
    """Blank labels become ``Unnamed``; the n-th repeat in ``order`` gets the suffix ``__n``."""
    base = F.when(F.trim(label) == "", "Unnamed").otherwise(F.coalesce(F.trim(label), F.lit("Unnamed")))
    numbered = row_index(df.withColumn("__base", base), ["__base"], order, "__k")
    text = F.when(F.col("__k") == 1, F.col("__base")).otherwise(F.concat_ws("__", "__base", (F.col("__k") - 1).cast("string")))
    return numbered.withColumn(out, text).drop("__base", "__k")


# A plant tag inside a text, and the suffix that numbers repeated descriptions.
TAG_TOKEN = r"\b\d+-\d+-[A-Z0-9]+(?:-[A-Z0-9]+)?\b"
REPEAT_SUFFIX = r"\s*~\^(\d+)\s*$"


def clean_description(c: str | Column, tag_token: str = TAG_TOKEN) -> Column:
    """Remove invisible characters and tag tokens, turn ``~^n`` into ``(n+1)``, tidy blanks and dots."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(c, r"\p{C}", "")
    nth = F.regexp_extract(s, REPEAT_SUFFIX, 1)
    number = F.when(nth != "", (nth.try_cast("bigint") + 1).cast("string"))
    marked = F.regexp_replace(s, F.lit(REPEAT_SUFFIX), F.concat(F.lit(" ("), F.coalesce(number, F.lit("")), F.lit(")")))
    s = F.when(number.isNotNull(), marked).otherwise(s)
    s = F.regexp_replace(s, tag_token, "")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    s = F.trim(F.regexp_replace(s, r"\s*:\s*$", ""))
    s = F.regexp_replace(s, r"^\.+\s*", "")
    return F.trim(F.regexp_replace(s, r"\s*\.+$", ""))


def translate_distinct(df: DataFrame, col: str, dictionary: DataFrame, src: str = "source", tgt: str = "target") -> DataFrame:
    """Replace a text by its dictionary entry; the text stays where there is none."""
    words = dictionary.select(F.col(src).alias(col), F.col(tgt).alias("__tgt"))
    needed = words.join(df.select(col).distinct(), col, "left_semi")
    out = join_stats(df, needed, [col])
    return out.withColumn(col, F.coalesce("__tgt", col)).drop("__tgt")


def coerce_numeric(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double").cast(to) for c in cols})


def summarize_table(df: DataFrame, name: str) -> DataFrame:
    """Row and column counts, shares of missing, infinite and sentinel values, duplicate rows.

    Rows are grouped by a hash of all columns first, so duplicates are counted without moving whole rows.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    cells = lambda cols, test: reduce(
        lambda a, b: a + b, [F.coalesce(test(F.col(f"`{c}`")).cast("int"), F.lit(0)) for c in cols], F.lit(0)
    )
    nulls = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in df.columns], F.lit(0))
    per_row = df.select(
        nulls.alias("m"),
        cells(real, lambda c: F.abs(c) == float("inf")).alias("i"),
        cells(numeric, lambda c: F.abs(c) == SENTINEL).alias("s"),
        F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256).alias("h"),
    )
    distinct = per_row.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), F.sum("i").alias("i"), F.sum("s").alias("s"))
    total = distinct.agg(
        F.sum("n").alias("n_rows"), F.sum("m").alias("m"), F.sum("i").alias("i"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("d")
    )
    rows, k = F.coalesce("n_rows", F.lit(0)), len(numeric)
    pct = lambda part, width: F.coalesce(F.try_divide(F.col(part) * 100.0, F.col("n_rows") * width), F.lit(0.0))
    return total.select(
        F.lit(name).alias("name"),
        rows.cast("bigint").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_cols"),
        pct("m", len(df.columns)).alias("missing_pct"),
        pct("i", max(k, 1)).alias("infinite_pct"),
        pct("s", max(k, 1)).alias("sentinel_pct"),
        (rows - F.col("d")).cast("bigint").alias("duplicate_rows"),
    )


def compare_tables(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    return summarize_table(before, f"Before {name}").unionByName(summarize_table(after, f"After {name}"))


def describe_table(df: DataFrame, ts: str) -> DataFrame:
    """Row and column counts and the time bounds over rows with a usable time."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_cols"),
        F.min(ts).alias("min_ts"),
        F.max(ts).alias("max_ts"),
    )

