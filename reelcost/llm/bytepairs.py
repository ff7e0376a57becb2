"""Byte-level BPE: ranked merges over the byte arrays of distinct words.

A word (a match of the split pattern) starts as its bytes, and the adjacent pair of lowest rank is
merged until none has a rank. Decoding concatenates the binary pieces of the ids. A document's text
is the concatenation of its words, so each distinct word is coded once and looked up afterwards.

Two forms give the same results. ``encode_decode_native`` is a fold of Spark's higher-order functions
with a literal rank map (an array of small maps addressed by a checksum). Its interpreted fold costs
far more than the check's limits allow (figures in the README), so ``encode_decode``, which the query
uses, runs the same merges on the words of Arrow batches with a bounded cache of coded words.
"""

from __future__ import annotations

import base64
import heapq
import json
import struct
import zlib
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

CACHED_WORDS = 400_000
LONG_WORD = 64
_NONE = 2**31 - 1
_WHITE = r"\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def explicit_white(pattern: str) -> str:
    """The split pattern with Unicode white space spelled out; libraries differ about \\s."""
    return pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")


def _buckets(entries: Iterable[tuple[str, object]], n: int, value_type: str) -> Column:
    """A constant array of n maps; key k is in the map number crc32(k) mod n."""
    parts: list[dict] = [{} for _ in range(n)]
    for k, v in entries:
        parts[zlib.crc32(k.encode()) % n][k] = v
    return F.from_json(F.lit(json.dumps(parts, ensure_ascii=False)), f"array<map<string,{value_type}>>")


def _find(buckets: Column, n: int, key: Column) -> Column:
    return F.element_at(F.element_at(buckets, (F.crc32(key.cast("binary")) % n + 1).cast("int")), key)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Codec:
    """Expressions for encoding and decoding with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = 1 << max(4, (len(ranks)).bit_length())
        self.ranks = _buckets(((b.hex().upper(), r) for b, r in ranks.items()), self.n, "int")
        pieces = [""] * (max(ranks.values(), default=0) + 1)
        for b, r in ranks.items():
            pieces[r] = b.hex().upper()
        self.pieces = F.split(F.lit(",".join(pieces)), ",")

    def rank(self, piece: Column) -> Column:
        return F.coalesce(_find(self.ranks, self.n, piece), F.lit(_NONE))

    def ids(self, word: Column) -> Column:
        """Ids of one non-empty word."""

        def fold(digits: Column) -> Column:
            size = F.length(digits) / 2
            part = lambda i: F.substring(digits, (2 * i + 1).cast("int"), F.lit(2))
            pair = lambda i: F.substring(digits, (2 * i + 1).cast("int"), F.lit(4))
            places = F.sequence(F.lit(0), (size - 1).cast("int"))
            start = F.transform(places, lambda i: F.struct(part(i).alias("p"), F.when(i + 1 < size, self.rank(pair(i))).otherwise(_NONE).alias("r")))
            return F.transform(F.aggregate(places, start, lambda s, _: self._merge(s)), lambda x: self.rank(x.p))

        whole = F.hex(F.encode(word, "UTF-8"))
        return _bind(whole, lambda d: _bind(self.rank(d), lambda r: F.when(r < _NONE, F.array(r)).otherwise(fold(d))))

    def _merge(self, s: Column) -> Column:
        ranks = F.transform(s, lambda x: x.r)

        def at(i: Column) -> Column:
            joined = F.concat(s[i - 1].p, s[i].p)

            def put(piece: Column) -> Column:
                before = F.when(i > 2, F.slice(s, F.lit(1), i - 2)).otherwise(F.slice(s, 1, 0))
                left = F.when(i > 1, F.array(F.struct(s[i - 2].p.alias("p"), self.rank(F.concat(s[i - 2].p, piece)).alias("r")))).otherwise(F.slice(s, 1, 0))
                after = F.slice(s, i + 2, F.size(s))
                new = F.struct(piece.alias("p"), F.when(i + 1 < F.size(s), self.rank(F.concat(piece, s[i + 1].p))).otherwise(_NONE).alias("r"))
                return F.concat(before, left, F.array(new), after)

            return _bind(joined, put)

        place = F.array_position(ranks, F.array_min(ranks)).cast("int")
        return F.when(F.array_min(ranks) < _NONE, _bind(place, at)).otherwise(s)

    def coded(self, word: Column) -> Column:
        """(number of ids, ids as little-endian hex, decoded bytes as hex) of one word."""

        def little(i: Column) -> Column:
            h = F.lpad(F.hex(i), 8, "0")
            return F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)])

        return _bind(
            self.ids(word),
            lambda ids: F.struct(
                F.size(ids).alias("n"),
                F.array_join(F.transform(ids, little), "").alias("ids"),
                F.array_join(F.transform(ids, lambda i: F.element_at(self.pieces, i + 1)), "").alias("bytes"),
            ),
        )


def encode_decode_native(df: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode_decode``, by higher-order functions alone; for words of moderate length."""
    codec = Codec(read_ranks(ranks_path))
    words = F.regexp_extract_all(text_of(text), F.lit(explicit_white(pattern)), F.lit(0))
    distinct = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("w"), codec.coded(w).alias("c"))))
    coded = df.select(F.col(doc_id).alias("doc_id"), words.alias("words"), distinct.alias("codes")).select("doc_id", F.transform("words", lambda w: F.element_at("codes", w)).alias("c"))
    return coded.select(
        "doc_id",
        F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x.n).alias("n_tokens"),
        F.unhex(F.array_join(F.transform("c", lambda x: x.ids), "")).alias("ids"),
        F.unhex(F.array_join(F.transform("c", lambda x: x.bytes), "")).alias("decoded"),
    )


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: its bytes, with the adjacent pair of lowest rank (leftmost first) merged until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _merged_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs:
        low = min(pairs)
        if low == _NONE:
            break
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for words on which a scan per merge would be quadratic."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if end[i] < 0 or j >= n or end[j] != stop:
            continue  # one side was merged meanwhile
        end[i], after[i], end[j] = stop, after[j], -1
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[word[i : end[i]]] for i in range(n) if end[i] > 0]


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded, both binary.

    Null text is empty and has no tokens. Repeated rows and null ids are kept as they are; other
    columns are not read.
    """

    def code(batches):
        ranks = read_ranks(ranks_path)
        piece = {r: b for b, r in ranks.items()}
        split = regex.compile(explicit_white(pattern)).findall
        known: dict[str, tuple[int, bytes, bytes]] = {}
        for batch in batches:
            counts, ids, decoded = [], [], []
            for t in batch.column(1):
                words = split(t.as_py() or "")
                for w in set(words):
                    if w not in known:
                        got = merged(w.encode(), ranks)
                        known[w] = len(got), struct.pack(f"<{len(got)}I", *got), b"".join([piece[i] for i in got])
                codes = [known[w] for w in words]
                counts.append(sum([c[0] for c in codes]))
                ids.append(b"".join([c[1] for c in codes]))
                decoded.append(b"".join([c[2] for c in codes]))
                if len(known) > cached_words:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    id_type = df.schema[doc_id].dataType.simpleString()
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(code, f"doc_id {id_type}, n_tokens long, ids binary, decoded binary")
