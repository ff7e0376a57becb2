"""Helpers shared by the corpus operators: stable tables, hashed words, bitsets, components."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.session import ensure_checkpoint_dir

# White space of the normalisation rules: blank and the six ASCII controls from tab to return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
# Text bytes that one numpy step works on; about forty times as much memory is used meanwhile.
SLICE_BYTES = 2_000_000
# Rows for which a fetched table still counts as small.
SMALL_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """Compute a table once and keep it in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps: its cleaner waits for the driver's garbage collector."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside leave no shuffle files behind; their results must be kept elsewhere."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names of added columns, lengthened until ``df`` has no column of that name in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``size`` bytes of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    group = np.cumsum(sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


_RANDOM = np.random.default_rng(20240607)
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.where(_IS_SPACE, np.uint64(0), _BYTE_VALUE[_LOWER])
# Text bytes hashed at a time, so that these steps stay in the processor's cache; bytes of a word whose powers differ.
_HASHED_BYTES = 1 << 17
_WORD_BYTES = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = np.cumprod(np.full(n - 1, base, dtype=np.uint64))
    return out


_POWERS = _powers(int(_BASE), 2 * _HASHED_BYTES)
# The base is odd, so its powers can be divided by.
_INVERSE = pow(int(_BASE), -1, 1 << 64)
_INVERSES = _powers(_INVERSE, 2 * _HASHED_BYTES)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse."""
    return (_POWERS, _INVERSES) if n <= len(_POWERS) else (_powers(int(_BASE), n), _powers(_INVERSE, n))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased, split at white space), and each text's first word.

    The second array has one more entry than texts, so text ``i`` owns words ``first[i]:first[i + 1]``.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset or texts.null_count:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    ends = np.flatnonzero(np.diff(offsets[1:] // _HASHED_BYTES)) + 1
    found, firsts, n = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for a, b in zip([0, *ends], [*ends, len(texts)]):
        words, first = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found.append(words)
        firsts.append(first[1:] + n)
        n += len(words)
    return np.concatenate(found), np.concatenate(firsts)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``hashed_words`` of the texts that lie between ``offsets`` in ``data``."""
    first = np.zeros(len(offsets), dtype=np.int64)
    # A place more than bytes, so that every text begins and ends at one.
    word = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not((data == 32) | (data - np.uint8(9) < 5), out=word[:-1])
    cut = np.ones(len(data) + 1, dtype=bool)
    np.logical_not(word[:-1], out=cut[1:])
    cut[offsets] = True
    starts = np.flatnonzero(word & cut)
    if not len(starts):
        return np.empty(0, np.uint64), first
    np.logical_not(word, out=cut)
    cut[offsets] = True
    ends = np.flatnonzero(cut[1:] & word[:-1]) + 1
    # Letter i of a word counts with power i: that of its place in the data over that of the word's start.
    powers, inverses = _powers_to(len(data))
    values = _LETTER.take(data, mode="wrap")
    values *= powers[: len(data)]
    sums = np.add.reduceat(values, starts) * inverses[starts]
    lengths = (ends - starts).astype(np.uint64)
    for i in np.flatnonzero(lengths > _WORD_BYTES):
        place = np.arange(ends[i] - starts[i])
        turn = (place // _WORD_BYTES << 1 | 1).astype(np.uint64)
        sums[i] = (_LETTER[data[starts[i] : ends[i]]] * powers[place % _WORD_BYTES] * turn).sum()
    first[:] = np.searchsorted(starts, offsets)
    return mix(sums + lengths * _BASE), first


def hashed_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (fewer rows than words by k - 1)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if k > 8:
        powers, inverses = _powers_to(len(words))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * inverses[: len(words)])])
        total = (sums[k:] - sums[:n]) * powers[:n] * powers[k - 1]
    else:
        total = words[:n].copy()
        for j in range(1, k):
            total *= _BASE
            total += words[j : j + n]
    return mix(total + np.uint64(k))


def fixed_bitset(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bloom bitset of a column of random 64-bit integers, gathered piece by piece.

    ``bits`` (a power of two) is fixed by the caller, so what reaches the driver is bounded.
    """
    pieces = max(1, bits // (1 << 19))

    def own(batches):
        seen = np.zeros(bits, dtype=bool)
        for b in batches:
            for p in bit_places(np.asarray(b.column(0)).view(np.uint64), bits):
                seen[p] = True
        packed = np.packbits(seen).reshape(pieces, -1)
        used = [i for i in range(pieces) if packed[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[i].tobytes() for i in used], pa.binary())], ["piece", "bits"])

    def merged(key, pdf):
        out = np.zeros(bits // pieces // 8, dtype=np.uint8)
        for b in pdf["bits"]:
            out |= np.frombuffer(b, dtype=np.uint8)
        return pdf.iloc[:1].assign(bits=[out.tobytes()])

    found = df.select(column).mapInArrow(own, "piece int, bits binary").groupBy("piece").applyInPandas(merged, "piece int, bits binary")
    packed = np.zeros((pieces, bits // pieces // 8), dtype=np.uint8)
    for r in found.toLocalIterator():
        packed[r["piece"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return packed.reshape(-1)


def bit_places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(bits - 1)
    return [((values >> np.uint64(s)) & mask).astype(np.int64) for s in (0, 17, 34)]


def bitset_of(df: DataFrame, column: str, rows: int, most: int = 1 << 27) -> np.ndarray:
    """Bitset with about twelve bits a row, at most ``most``; when full it only filters less."""
    bits = 1 << 16
    while bits < 12 * rows and bits < most:
        bits *= 2
    return fixed_bitset(df, column, bits)


def in_bitset(values: np.ndarray, packed: np.ndarray) -> np.ndarray:
    ok = np.ones(len(values), dtype=bool)
    for p in bit_places(values, len(packed) * 8):
        ok &= (packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components as (node, label): the label is the component's smallest node.

    Every round takes the smallest label among neighbours and then follows that label one step;
    labels and links stay in Spark, a round ends with a count of changed labels.
    """
    both = kept(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a))).distinct())
    labels = kept(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = kept(step.join(up, "label", "left").select("node", "was", F.coalesce(F.least("up", "label"), "label").alias("label")))
        labels = new.select("node", "label")
        if new.filter(F.col("was") != F.col("label")).isEmpty():
            return labels
