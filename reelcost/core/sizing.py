"""Size checks that decide between a broadcast and a shuffle, or one block and many."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import ensure_checkpoint_dir

# A side with at most this many rows may be collected and broadcast.
BROADCAST_ROWS = 20_000
# Input bytes that one window task should hold at most.
BLOCK_BYTES = 64 * 1024 * 1024
MAX_BLOCKS = 20_000
# Spark reports a size beyond any real one for relations without statistics.
UNKNOWN_BYTES = 2**60


def input_bytes(df: DataFrame) -> int:
    """Total size of the leaf relations below ``df``, from plan statistics (no job)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        total += int(str(leaves.apply(i).stats().sizeInBytes()))
    return total


def block_count(df: DataFrame) -> int:
    size = input_bytes(df)
    if size >= UNKNOWN_BYTES:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(MAX_BLOCKS, math.ceil(size / BLOCK_BYTES)))


def is_small(df: DataFrame) -> bool:
    return block_count(df) == 1


def counted_blocks(df: DataFrame, rows: int = 1_000_000) -> int:
    """Blocks of a kept table by its rows: plan statistics of a kept join or aggregate exceed its real size by far."""
    return max(1, min(MAX_BLOCKS, math.ceil(df.count() / rows)))


def pin_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Fetch a table of at most ``max_rows`` rows once and hand it back as a local relation.

    Beyond the limit the lazy table is returned with ``False`` and nothing was kept.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(table, df.schema), True


def written(df: DataFrame) -> DataFrame:
    """A table of any size that later steps read several times, computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def materialise(df: DataFrame, max_rows: int = BROADCAST_ROWS, costly: bool = False) -> DataFrame:
    """A table that later steps read many times: a local relation when small, else a checkpoint.

    A ``costly`` table is written first, so that it is computed once whatever its size.
    """
    if costly:
        ensure_checkpoint_dir(df.sparkSession)
        kept = df.checkpoint()
        return pin_if_small(kept, max_rows)[0]
    small, fits = pin_if_small(df, max_rows)
    if fits:
        return small
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool) -> Column:
    pairs = [
        left[k].eqNullSafe(right[f"__r_{k}"]) if null_safe else left[k] == right[f"__r_{k}"]
        for k in keys
    ]
    return reduce(lambda a, b: a & b, pairs)


def join_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Attach per-key statistics to rows.

    The statistics are broadcast only when a bounded fetch proves that they are small, so a
    hot key never moves the rows. Otherwise it is a plain shuffle join, where adaptive
    skew handling splits hot partitions.
    """
    small, fits = pin_if_small(stats, max_rows)
    if not keys:
        if not fits:
            raise ValueError("statistics without keys must be one row")
        return rows.crossJoin(F.broadcast(small))
    right = small.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in small.columns if c not in keys],
    )
    side = F.broadcast(right) if fits else right
    out = rows.join(side, _match(rows, right, keys, null_safe), how)
    return out.drop(*[f"__r_{k}" for k in keys])
