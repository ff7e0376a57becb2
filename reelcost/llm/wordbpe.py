"""BPE with word ends: merges found by a segment tree over the ranks of adjacent pairs.

A vocabulary file of the tokenizers library tells how text is normalised and split into words; that library's
normaliser and splitter are used as they are. The merges are this module's: a word is a list of symbols,
the last one with the end-of-word mark, and the leaves of a segment tree hold the rank of each
adjacent pair. The root is the leftmost pair of lowest rank; merging it changes the pair before and
the pair after and removes one, three point updates of logarithmic cost, until the root says that no pair has a rank.

No word crosses one of the six ASCII white-space characters, so text is cut there first. Arrow cuts a few megabytes at
a time and tells their distinct stretches apart; each of these is coded once a task, with a bounded cache.
"""

from __future__ import annotations

import functools
import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slices

# Words and stretches that a Python worker remembers, from task to task.
CACHED_WORDS = 400_000
CACHED_STRETCHES = 600_000
# Longer stretches are coded each time they come, so the cache stays small.
CACHED_BYTES = 256
_NONE = 1 << 62
# Letters that are one composed character each, in lower case too.
_LETTERS = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_is_latin = regex.compile(f"[ -~{_LETTERS}]*").fullmatch
# Text bytes whose stretches are told apart at a time.
SPLIT_BYTES = 8_000_000


def lowest_pairs(leaves: list[int]) -> list[int]:
    """Segment tree over pairs, each ``rank << 32 | place`` or _NONE: node 1 holds the lowest, node i that of nodes 2i and 2i + 1."""
    tree = [0] * len(leaves) + leaves
    for i in range(len(leaves) - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    return tree


def set_node(tree: list[int], i: int, leaf: int) -> None:
    """Replace the leaf at node ``i``; nodes above change until one keeps its lowest."""
    tree[i] = leaf
    while i > 1:
        b = tree[i ^ 1]
        if b < leaf:
            leaf = b
        i >>= 1
        if tree[i] == leaf:
            break
        tree[i] = leaf


def put(tree: list[int], *changes: tuple[int, int]) -> None:
    """Replace pairs (place, leaf)."""
    for place, leaf in changes:
        set_node(tree, place + (len(tree) >> 1), leaf)


def merged(symbols: list[int], ranks: list[dict[int, int]], made: list[int]) -> list[int]:
    """Symbols after all merges; ``ranks[a][b]`` is the rank of a pair << 32, ``made`` the symbol that the merge of a rank makes."""
    n = len(symbols)
    if n < 2:
        return symbols
    tree = lowest_pairs([ranks[a].get(b, _NONE) | i for i, (a, b) in enumerate(zip(symbols, symbols[1:]))])
    # Leaf j of the tree is node j + n - 1.
    top, after, before = n - 1, list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) < _NONE:
        i = root & 0xFFFFFFFF
        j, new = after[i], made[root >> 32]
        k, h = after[j], before[i]
        symbols[i], symbols[j], after[i] = new, -1, k
        own = _NONE
        if k < n:
            before[k] = i
            own = ranks[new].get(symbols[k], _NONE) | i
            if tree[j + top] < _NONE:
                set_node(tree, j + top, _NONE)
        set_node(tree, i + top, own)
        if h >= 0:
            own = ranks[symbols[h]].get(new, _NONE) | h
            if own < _NONE or tree[h + top] < _NONE:
                set_node(tree, h + top, own)
    return [s for s in symbols if s >= 0]


class Recent:
    """Cache of at most twice ``size`` entries that loses the ones not asked for lately."""

    def __init__(self, size: int):
        self.size, self.new, self.old = max(1, size), {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


def _ascii_split(spec: dict):
    """Words of lower-case printable ASCII by the file's own pattern, where its steps are the ones known to agree there."""
    steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
        return None
    if cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
        return None
    return regex.compile(cuts[0]["pattern"]["Regex"]).findall


class Coder:
    """Encodes stretches of text by the vocabulary file at ``path``."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS, cached_stretches: int = CACHED_STRETCHES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = [{} for _ in range(max(self.vocab.values()) + 1)]
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a]][self.vocab[b]] = rank << 32
        self.made = [self.vocab[a + b] for a, b in pairs]
        # Tokens have a blank before them: texts lose the first one.
        self.piece = {i: b" " + t.encode() for t, i in self.vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.piece.update({i: b" " + t.encode() for t, i in special.items()})
        self.special = special
        # A character of every special token's, so that most texts are searched for one only.
        self.mark = min(set.intersection(*map(set, special)), default="") if special else ""
        self.cuts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        library = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.ascii = _ascii_split(spec)
        self.latin = {ord(c): self.split(c)[0][0] for c in _LETTERS} if self.ascii else {}
        self.words, self.stretches = Recent(cached_words // 2), Recent(cached_stretches // 2)

    def code(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        """Number of ids, ids as little-endian integers, tokens with a blank before each."""
        return len(ids), struct.pack(f"<{len(ids)}I", *ids), b"".join([self.piece[i] for i in ids])

    def word(self, word: str) -> tuple[int, bytes, bytes]:
        found = self.words.get(word)
        if found is None:
            found = self.code(merged([*[self.vocab[c] for c in word[:-1]], self.vocab[word[-1] + self.end]], self.ranks, self.made))
            if len(word) <= CACHED_BYTES:
                self.words.put(word, found)
        return found

    def codes(self, text: str) -> list[tuple[int, bytes, bytes]]:
        """Codes of a text's words; strings of special tokens are these tokens."""
        if self.ascii and self.mark and self.mark not in text and text.isascii() and text.isprintable():
            return [self.word(w) for w in self.ascii(text.lower())]
        out = []
        for part in self.cuts.split(text) if self.special and self.mark in text and any([t in text for t in self.special]) else [text]:
            if part in self.special:
                out.append(self.code([self.special[part]]))
            elif self.ascii and part.isascii() and part.isprintable():
                out += [self.word(w) for w in self.ascii(part.lower())]
            elif self.ascii and _is_latin(part):
                out += [self.word(w.translate(self.latin)) for w in self.ascii(part.lower())]
            elif part:
                out += [self.word(w) for w, _ in self.split(self.normal(part))]
        return out

    def stretch(self, text: str) -> tuple[int, bytes, bytes]:
        """As ``code``, for a stretch without white space."""
        found = self.stretches.get(text)
        if found is None:
            codes = self.codes(text)
            found = codes[0] if len(codes) == 1 else self.joined(codes)
            if len(text) <= CACHED_BYTES:
                self.stretches.put(text, found)
        return found

    def joined(self, codes: list[tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes]:
        counts, ids, tokens = zip(*codes) if codes else ((), (), ())
        return sum(counts), b"".join(ids), b"".join(tokens)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Of whole texts the numbers of ids, the ids as little-endian integers, and the tokens joined by blanks."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        ends, told = np.asarray(cut.offsets), cut.values.dictionary_encode()
        counts, ids, tokens = zip(*[self.stretch(t) for t in told.dictionary.to_pylist()]) if len(told) else ((), (), ())
        total = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[np.asarray(told.indices)])])
        # Stretches taken one after another lie in one buffer, so a text's codes are a range of it.
        out = []
        for column, blank in ((ids, 0), (tokens, 1)):
            _, at, data = pa.array(column, pa.large_binary()).take(told.indices).buffers()
            at = np.frombuffer(at, np.int64)[ends]
            data = np.frombuffer(data, np.uint8, at[-1]) if data is not None else np.empty(0, np.uint8)
            if blank:
                some = at[1:] > at[:-1]
                data, at = np.delete(data, at[:-1][some]), at - np.concatenate([[0], np.cumsum(some)])
            out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary()))
        return np.diff(total[ends]), *out

    def text(self, raw: bytes) -> tuple[int, bytes, bytes]:
        """As ``texts``, for one text."""
        count, ids, tokens = self.texts(pa.array([raw.decode()]))
        return int(count[0]), ids[0].as_py(), tokens[0].as_py()


@functools.lru_cache(maxsize=1)
def _coder(path: str, cached_words: int, cached_stretches: int) -> Coder:
    return Coder(path, cached_words, cached_stretches)


def encode_decode(
    df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", cached_words: int = CACHED_WORDS, cached_stretches: int = CACHED_STRETCHES
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded, both binary.

    Decoded text is what a vocabulary without a decoder gives: the ids' tokens, word ends included, joined by
    blanks. Null text is empty; it and text of white space alone have no tokens. Repeated rows and null ids are
    kept as they are, an empty table stays empty, other columns are not read.
    """

    def code(batches):
        coder = _coder(path, cached_words, cached_stretches)
        for batch in batches:
            for part in slices(batch, "text", SPLIT_BYTES):
                counts, ids, decoded = coder.texts(part.column("text").fill_null(""))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), ids, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    id_type = df.schema[doc_id].dataType.simpleString()
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(code, f"doc_id {id_type}, n_tokens long, ids binary, decoded binary")
