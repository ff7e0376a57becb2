"""Packing of token sequences: first-fit decreasing over a tournament tree, group by group.

A document's tokens are cut into full pieces, each a sequence of its own, and at most one remainder.
Remainders are dealt at random into groups of bounded size; in each group they go, longest first,
into the leftmost bin with room, which a tournament tree of free capacities finds in a logarithm of steps.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices

LENGTH = 1024
GROUP_DOCS = 8192
# Latin texts, for which both tokenizer libraries split words alike; others go to the slower one.
_OTHER = re.compile("[^\x00-ɏ]|<\\|endoftext\\|>")
_LOADED: dict[tuple[str, str], object] = {}


def encoder(json_path: str, ranks_path: str | None):
    """A function from text to ids, loaded once per Python worker.

    ``ranks_path`` names the same vocabulary as ranks: the faster library then takes plain
    Latin texts, where the two agree, and the other one the rest.
    """
    key = (json_path, ranks_path or "")
    if key not in _LOADED:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(json_path)

        def exact(text: str) -> np.ndarray:
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

            def ids(text: str) -> np.ndarray:
                return exact(text) if _OTHER.search(text) else np.array(fast.encode_ordinary(text), dtype="<u4")

            _LOADED[key] = ids
        else:
            _LOADED[key] = exact
    return _LOADED[key]


class FreeSpace:
    """Tournament tree: each inner node holds the larger free capacity of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Leftmost bin with room for ``size``; gives (bin, room before)."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        room = best[node]
        found = node - self.leaves
        best[node] = room - size
        node //= 2
        while node:
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node] = top
            node //= 2
        return found, room


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, handled longest first; equal sizes in the given order."""
    tree = FreeSpace(max(1, len(sizes)), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i], room = tree.take(sizes[i])
        offsets[i] = capacity - room
    return bins, offsets


def pack(
    df: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end_id: int = 0,
    group_docs: int = GROUP_DOCS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null text is empty, so such a document is its closing id alone. Repeated rows are packed as often
    as they occur; a null doc_id stays null. An empty table gives no pieces. ``with_ids`` adds each
    piece's ids as little-endian unsigned 32-bit binary.
    """

    def cut(batches):
        encode = encoder(json_path, ranks_path)
        for b in batches:
            for part in slices(b, "text"):
                rows, starts, sizes, totals, sums, raw = [], [], [], [], [], []
                for r, t in enumerate(part.column("text")):
                    ids = np.append(encode(t.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), length):
                        piece = ids[s : s + length].tobytes()
                        rows.append(r)
                        starts.append(s)
                        sizes.append(len(piece) // 4)
                        totals.append(len(ids))
                        sums.append(zlib.crc32(piece))
                        raw.append(piece)
                cols = [part.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in (starts, sizes, sums, totals)]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    id_type = df.schema[doc_id].dataType.simpleString()
    more = ", ids binary" if with_ids else ""
    shape = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pieces = kept(source.mapInArrow(cut, shape + more).withColumn("rid", F.monotonically_increasing_id()))
    # A full piece is a sequence of its own; only remainders, at most one a document, meet in groups.
    full = pieces.filter(F.col("length") == length).withColumns({"sequence_id": 2 * F.col("rid") + 1, "offset": F.lit(0).cast("long")})
    rest = pieces.filter(F.col("length") < length)
    groups = max(1, -(-rest.count() // group_docs))
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64(F.lit("deal"), F.col("rid")), F.lit(groups)))

    def place(key, group):
        group = group.sort_by("rid")
        bins, offsets = first_fit_decreasing(group.column("length").to_pylist(), length)
        number = pa.array(2 * ((key[0].as_py() << 32) + bins))
        return group.drop_columns(["rid", "grp"]).append_column("sequence_id", number).append_column("offset", pa.array(offsets))

    placed = dealt.groupBy("grp").applyInArrow(place, f"{shape}{more}, sequence_id long, offset long")
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return full.select(order).union(placed.select(order))
