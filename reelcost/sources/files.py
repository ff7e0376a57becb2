"""File sources and sinks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.sizing import join_stats, materialise


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder that every executor can reach: below the shared folder, or local in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="reelcost-"), name)


def path_exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def read_months(spark: SparkSession, root: str, months: Sequence[str], pattern: str = "{root}/month={month}") -> DataFrame:
    """Union of the monthly folders that exist, with the union of their columns."""
    paths = [(m, pattern.format(root=root, month=m)) for m in months]
    found = [(m, p) for m, p in paths if path_exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"no month of {list(months)} below {root}")
    parts = [spark.read.parquet(p).withColumn("month", F.lit(m)) for m, p in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ";") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=False)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


HEADER_LINES = 6


def wrapped_headers(spark: SparkSession, path: str | Sequence[str], sep: str = "\t") -> DataFrame:
    """One row per file of a sensor export: its six header lines and the tags, units and descriptions they give.

    Tasks read the headers. A file's first lines stand in order at the start of its first split, so each task keeps the
    first six lines of the files whose start it holds. Files with fewer lines give no row.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))

    def first_lines(frames):
        name, head = None, []
        for pdf in frames:
            for file, g in pdf.groupby("file", sort=False):
                if file != name:
                    name, head = file, []
                if len(head) < HEADER_LINES:
                    head += g["value"].head(HEADER_LINES - len(head)).tolist()
                    if len(head) == HEADER_LINES:
                        yield pd.DataFrame([(file, head, *header_fields(head, sep))], columns=["file", "head", "tags", "units", "texts"])

    schema = "file string, head array<string>, tags array<string>, units array<string>, texts array<string>"
    return lines.filter("at = 0").select("value", "file").mapInPandas(first_lines, schema)


def header_fields(head: Sequence[str], sep: str) -> tuple[list[str], list[str], list[str]]:
    """Tags, units and descriptions of six header lines; a wrapped line that starts blank goes on with its second field."""
    units, tags = head[4].split(sep), head[5].split(sep)
    tags[0], units[0] = "Time", "datetime"
    texts = list(head[0].split(sep))
    for line in head[1:4]:
        parts = line.split(sep)
        texts.extend(parts if parts[0].strip() else parts[1:])
    width = len(tags)
    texts, units = ((x + [""] * width)[:width] for x in (texts, units))
    texts[0] = texts[0].strip() or "Time"
    return unique_names(tags), units, texts


# A table wider than this is better read in long form.
MAX_TAGS = 20_000


def read_wrapped_headers(spark: SparkSession, path: str | Sequence[str], sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """All sensor exports below a path: measurements with the union of the files' tags, and the tag table.

    Every file has its own tags, in its own order. Measurements carry ``file``, ``Time`` and one DOUBLE per tag: tags that a
    file lacks, missing fields and text that is no number become NULL, surplus fields are ignored, bad times become NULL.
    Only the distinct tag names, which are the columns of the result, come to the driver.
    """
    headers = materialise(wrapped_headers(spark, path, sep))
    places = headers.select(F.posexplode("tags").alias("place", "tag")).groupBy("tag").agg(F.min("place").alias("place"))
    found = places.orderBy("place", "tag").limit(MAX_TAGS + 1).collect()
    if not found:
        raise ValueError(f"{path}: expected {HEADER_LINES} header lines")
    if len(found) > MAX_TAGS:
        raise ValueError(f"{path}: more than {MAX_TAGS} tags")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    data = join_stats(lines, headers.select("file", "head", "tags"), ["file"], how="inner").filter(~F.array_contains("head", F.col("value")))
    fields = F.split("value", re.escape(sep), -1)
    # The slices make both arrays equally long, whatever the line holds.
    width = F.least(F.size("tags"), F.size("__f"))
    data = data.withColumn("__f", fields).withColumn("__m", F.map_from_arrays(F.slice("tags", F.lit(1), width), F.slice("__f", F.lit(1), width)))
    rows = data.select(
        "file",
        F.try_to_timestamp(F.col("__m")["Time"]).alias("Time"),
        *[F.col("__m")[r.tag].try_cast("double").alias(r.tag) for r in found if r.tag != "Time"],
    )
    pairs = F.arrays_zip(F.col("tags").alias("tag"), F.col("units").alias("unit"), F.col("texts").alias("description"))
    return rows, headers.select("file", F.explode(pairs).alias("t")).select("file", "t.tag", "t.unit", "t.description")


def read_wrapped_header(spark: SparkSession, path: str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """One sensor export with four wrapped description lines, a unit line and a tag line, see `read_wrapped_headers`."""
    rows, meta = read_wrapped_headers(spark, path, sep)
    return rows.drop("file"), meta.drop("file")


def unique_names(names: Sequence[str]) -> list[str]:
    """Blank names become ``Unnamed``; repeats get ``__1``, ``__2`` and so on."""
    plain = [str(n).strip() or "Unnamed" for n in names]
    places = pd.Series(plain, dtype=object).groupby(plain).cumcount() if plain else []
    return [n if k == 0 else f"{n}__{k}" for n, k in zip(plain, places)]
