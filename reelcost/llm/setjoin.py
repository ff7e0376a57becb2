"""Near duplicates: exact Jaccard join on word shingles with token-combination prefixes.

Documents with equal shingle sets form a class, named by a hash of the set. Shingles that occur
once in the corpus can't be shared. A first count, over a fixed part of each set, rules out sets that
can't have a partner; only the others are counted in full. What remains is ordered from rare to frequent. Two sets with
Jaccard >= t differ in at most n - ceil(t n) shingles of either, so a long enough prefix of the
order must share something: single shingles for the rare class, pairs of shingles for the
frequent ones, where a group of g frequent shingles in the prefix gives at most g - 1 safe places
and the prefix is extended accordingly. Candidates that share a key are verified exactly.

Nothing emits all pairs of a key. First every class is verified against the most central class
of each of its keys. Only classes that are in different components after that and share a key
are paired, under size and position bounds; they are few, and the result is complete.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitset_of, components, free_names, hashed_runs, hashed_words, in_bitset, kept, mix, release, slices

WORDS = 5
PERCENT = 75
RARE_DF = 64
FREQUENT_GROUPS = 8


def shingle_sets(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and each text's first one; fewer than k words count as one shingle.

    The second array has one more entry than texts, so text ``i`` owns shingles ``first[i]:first[i + 1]``.
    """
    words, first = hashed_words(texts)
    size = np.diff(first)
    row, runs = np.repeat(np.arange(len(size)), size), hashed_runs(words, k)
    whole = np.flatnonzero(np.arange(len(runs)) + k <= first[1:][row[: len(runs)]])
    small = np.flatnonzero((size > 0) & (size < k))
    flat = np.concatenate([runs[whole], *[hashed_runs(words[first[i] : first[i + 1]], int(size[i])) for i in small]])
    row = np.concatenate([row[whole], small])
    if len(small):
        order = np.argsort(row, kind="stable")
        flat, row = flat[order], row[order]
    ends = np.searchsorted(row, np.arange(len(size) + 1)).tolist()
    for a, b in zip(ends, ends[1:]):
        flat[a:b].sort()
    once = np.ones(len(flat), dtype=bool)
    once[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    return flat[once], np.searchsorted(row[once], np.arange(len(size) + 1))


def _lists(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.view(np.int64)))


def _counted(ok: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of true entries of each set."""
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(ok)])[first])


def _picked(flat: np.ndarray, first: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The true entries of all sets, as ``shingle_sets`` gives them."""
    return flat[ok], np.concatenate([np.zeros(1, np.int64), np.cumsum(_counted(ok, first))])


def _probe(first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are among the smallest hashes of their set, and how many of these any partner has among its own smallest.

    A partner misses at most n - ceil(t n) shingles of the set, so of as many and m more it has m.
    """
    size = np.diff(first)
    more = 1 + size // 10
    place = np.arange(first[-1]) - np.repeat(first[:-1], size)
    return place < np.repeat(size - _least(size, percent) + more, size), more


def _alive(flat: np.ndarray, first: np.ndarray, probes: np.ndarray | None, percent: int) -> np.ndarray:
    """Whether each set can have a partner, judged by the repeated ones of its probe shingles."""
    if probes is None:
        return np.diff(first) > 0
    own, need = _probe(first, percent)
    own[own] = in_bitset(flat[own], probes)
    return (_counted(own, first) >= need) & (np.diff(first) > 0)


def _repeated(docs: DataFrame, k: int, percent: int, probes: np.ndarray | None = None) -> DataFrame:
    """Shingles that occur in more than one row: of the probe shingles, or of all in sets still alive.

    They are counted per batch before the shuffle.
    """

    def count(batches):
        for b in batches:
            for part in slices(b, "text"):
                flat, first = shingle_sets(part.column("text"), k)
                ok = _probe(first, percent)[0] if probes is None else np.repeat(_alive(flat, first, probes, percent), np.diff(first))
                tokens, n = np.unique(flat[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1").select("token")


def _some(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, shared: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the shingles that may occur elsewhere; none if they are too few for any partner."""
    ok = in_bitset(flat, shared)
    return _picked(flat, first, ok & np.repeat(100 * _counted(ok, first) >= percent * sizes, np.diff(first)))


def _hashed(docs: DataFrame, id_type: str, probes: np.ndarray, shared: np.ndarray, k: int, percent: int) -> DataFrame:
    """Per row: size of its set, name of its class, and the shingles that may occur elsewhere."""

    def sets(batches):
        for b in batches:
            for part in slices(b, "text"):
                flat, first = shingle_sets(part.column("text"), k)
                size, ends = np.diff(first), first.tolist()
                names = [hashlib.blake2b(flat[x:y], digest_size=16).digest() for x, y in zip(ends, ends[1:])]
                some = _some(*_picked(flat, first, np.repeat(_alive(flat, first, probes, percent), size)), size, shared, percent)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(names, pa.binary()), _lists(*some)], ["doc_id", "n", "c", "tokens"])

    return docs.mapInArrow(sets, f"doc_id {id_type}, n long, c binary, tokens array<long>")


def _narrowed(sets: DataFrame, shared: np.ndarray, percent: int) -> DataFrame:
    def narrow(batches):
        for b in batches:
            if b.num_rows:
                tokens = b.column("tokens")
                first = np.asarray(tokens.offsets).astype(np.int64)
                flat = np.asarray(tokens.values)[first[0] : first[-1]].view(np.uint64)
                some = _some(flat, first - first[0], np.asarray(b.column("n")), shared, percent)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("c"), b.column("n"), _lists(*some)], ["id", "c", "n", "tokens"])

    return sets.mapInArrow(narrow, "id long, c binary, n long, tokens array<long>")


def _least(n, percent: int = PERCENT):
    """Smallest overlap that a set of n shingles needs with any partner."""
    return -(-percent * n // 100)


def _keys(sets: DataFrame, percent: int, rare_df: int, groups: int) -> DataFrame:
    """Index keys of each class: (key, c, n, s, pos, hidden).

    ``s`` shingles are shared at all, ``pos`` is the place of the key's first shingle, and ``hidden`` shared
    ones may stand before it without a key of their own: one in each other frequent group begun by then.
    """

    def emit(batches):
        for b in batches:
            cols = {"key": [], "row": [], "pos": [], "hidden": []}
            sizes = b.column("n").to_pylist()
            for r, (items, n) in enumerate(zip(b.column("items"), sizes)):
                tokens = np.asarray(items.values.field("token")).view(np.uint64)
                dfs = np.asarray(items.values.field("df"))
                lone = n - len(tokens)
                need = n - _least(n, percent) + 1 - lone
                singles, pairs, pos_s, pos_p = [], [], [], []
                grouped: dict[int, list[int]] = {}
                for i in range(len(tokens)):
                    if need <= 0:
                        break
                    if dfs[i] <= rare_df:
                        singles.append(i)
                        need -= 1
                    else:
                        g = grouped.setdefault(int(tokens[i] % np.uint64(groups)), [])
                        g.append(i)
                        need -= len(g) > 1
                for g in grouped.values():
                    for y in range(1, len(g)):
                        for x in range(y):
                            pairs.append((g[x], g[y]))
                if need > 0:  # the whole set is too small for safe pairs
                    singles += [i for g in grouped.values() for i in g]
                begun = np.sort([g[0] for g in grouped.values()])
                if singles:
                    cols["key"].append(mix(tokens[singles]))
                    cols["pos"].append(np.array(singles) + lone)
                    cols["hidden"].append(np.searchsorted(begun, singles))
                if pairs:
                    x, y = np.array(pairs).T
                    cols["key"].append(mix(mix(tokens[x]) + tokens[y]))
                    cols["pos"].append(x + lone)
                    cols["hidden"].append(np.searchsorted(begun, x))
                cols["row"].append(np.full(len(singles) + len(pairs), r))
            key = np.concatenate(cols["key"]) if cols["key"] else np.empty(0, np.uint64)
            pos = np.concatenate(cols["pos"]) if cols["pos"] else np.empty(0, np.int64)
            hidden = np.concatenate(cols["hidden"]) if cols["hidden"] else np.empty(0, np.int64)
            row = np.concatenate(cols["row"]) if cols["row"] else np.empty(0, np.int64)
            row = pa.array(row.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), b.column("c").take(row), b.column("n").take(row), b.column("s").take(row), pa.array(pos.astype(np.int64)), pa.array(hidden.astype(np.int64))],
                ["key", "c", "n", "s", "pos", "hidden"],
            )

    return sets.select("c", "n", "s", "items").mapInArrow(emit, "key long, c long, n long, s long, pos long, hidden long")


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) pairs of classes: shared shingles ``i``, and whether they link."""
    side = lambda x: sets.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.transform("items", lambda i: i.token).alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("i", F.size(F.array_intersect("t_a", "t_b")))
    return both.select("a", "b", "i", (100 * F.col("i") >= percent * (F.col("n_a") + F.col("n_b") - F.col("i"))).alias("link"))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT, rare_df: int = RARE_DF, groups: int = FREQUENT_GROUPS
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, class_id (hash of the shingle set), component_id.

    Null text is empty; a document without words has no shingles, links with nothing and is its own
    component. Equal sets link. A component is named by its smallest doc_id; rows that repeat a
    doc_id count as one document, and a null doc_id names no component that has another id.
    """
    id_type = df.schema[doc_id].dataType.simpleString()
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    first = kept(_repeated(docs, k, percent))
    release(df.sparkSession)
    probes = bitset_of(first, "token", first.count())
    shared = kept(_repeated(docs, k, percent, probes))
    release(df.sparkSession)
    rows = kept(_hashed(docs, id_type, probes, bitset_of(shared, "token", shared.count()), k, percent))

    # A partner holds at least ``percent`` of a set, so classes with fewer shared shingles drop out, and then
    # shingles that no other remaining class has; filters in place first, an exact count at the end.
    classes = rows.filter(F.size("tokens") > 0).groupBy("c").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    sets = kept(classes.select(F.monotonically_increasing_id().alias("id"), "c", "n", "tokens"))
    for _ in range(2):
        release(df.sparkSession)
        again = kept(sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token"))
        sets = kept(_narrowed(sets, bitset_of(again, "token", again.count()), percent).filter(F.size("tokens") > 0))
    names = sets.select("id", "c")
    flat = sets.select("id", "n", F.explode("tokens").alias("token"))
    df_of = flat.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    found = flat.join(df_of, "token").groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("items"))
    found = found.filter(100 * F.size("items") >= percent * F.col("n"))
    sets = kept(found.select(F.col("id").alias("c"), "n", "items", F.size("items").cast("long").alias("s")))
    release(df.sparkSession)

    keys = kept(_keys(sets, percent, rare_df, groups))
    centre = F.min(F.struct((-F.col("s") / F.col("n")).alias("rank"), F.col("c").alias("c"), F.col("n").alias("n"))).alias("best")
    centres = kept(keys.groupBy("key").agg(F.count("*").alias("k"), centre).filter("k > 1"))
    star = keys.join(centres, "key").filter(F.col("best.c") != F.col("c")).select(F.col("c").alias("a"), F.col("best.c").alias("b")).distinct()
    known = kept(_overlaps(star, sets, percent))
    links = known.filter("link").select("a", "b")
    label = components(links, "a", "b")

    tagged = keys.join(centres.select("key", F.col("best.c").alias("b")), "key").join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    tagged = kept(tagged)
    mixed = tagged.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter(F.col("lo") != F.col("hi")).select("key")
    to_centre = known.select(F.col("a").alias("c"), "b", "i")
    open_ = tagged.join(mixed, "key").join(to_centre, ["c", "b"], "left").withColumn("i", F.coalesce("i", "s"))
    open_ = kept(open_)
    x, y = open_.alias("x"), open_.alias("y")
    fits = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    # Two bounds on what a pair shares: what follows its first shared key and what may be hidden before it; and
    # what both share with the key's centre, plus what they have beside that.
    after = F.least(F.col("x.n") - F.col("x.pos") + F.col("x.hidden"), F.col("y.n") - F.col("y.pos") + F.col("y.hidden"))
    through = F.least("x.i", "y.i") + F.least(F.col("x.s") - F.col("x.i"), F.col("y.s") - F.col("y.i"))
    enough = F.least(after, through) * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    pair = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & fits & enough)
    second = kept(_overlaps(pair.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct(), sets, percent).filter("link").select("a", "b"))
    if not second.isEmpty():
        label = components(links.union(second), "a", "b")

    # From here classes have their own names again: a component by its smallest class number, any other class by its hash.
    label = names.join(label, names.id == label.node).select("c", F.col("label").cast("string").alias("label"))
    named = kept(rows.select("doc_id", "n", "c").join(label, "c", "left").withColumn("label", F.coalesce("label", F.hex("c"))))
    smallest = kept(named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("first_id")))
    alone = F.when(F.col("n") > 0, F.col("label"))
    return (
        named.withColumn("label", alone)
        .join(smallest, "label", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.hex("c").alias("class_id"), F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose document names its component, and rows without an id."""
    (other,) = free_names(df, "__id")
    gone = near_duplicates(df, doc_id, text).filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(other)).distinct()
    return df.join(gone, F.col(doc_id) == F.col(other), "left_anti")
