"""Hard negatives, word-end BPE and the prefix trie against brute force or the library they must equal."""

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelcost.core.session import ship_package
from reelcost.llm import hardnegatives, prefixtrie, wordbpe

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def brute_negatives(rows, every, positives, negatives):
    rows = [(n, i, v, lab) for n, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = {n: [math.floor(256 * x) if abs(x) < 2**52 else int(x) * 256 for x in v] for n, _, v, _ in rows}
    out = []
    for n, i, v, lab in rows:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(whole[n], whole[m])), j, other) for m, j, w, other in rows if m != n and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            fit = sorted(x for x in scored if x[2] != lab and -50 * s <= -100 * x[0] <= -95 * s)[:negatives]
            out += [(i, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, dim, size=1.0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = [round(r.gauss(0.4, 1) * size, 2) for _ in range(dim)]
        rows.append((i, v, r.randrange(3)))
    rows += [(n, None, 1), (n + 1, [1.0] * dim, None), (None, [1.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [float("inf")] + [0.0] * (dim - 1), 1)]
    rows += [(n + 4, [None] + [0.0] * (dim - 1), 1), rows[10], rows[10], (20, [1.0] * (dim + 1), 1), (25, [], 0), (26, [], 0), (n + 5, [0.0] * dim, 0)]
    return rows


@pytest.mark.parametrize("seed,dim,size,shard", [(1, 5, 1.0, 16), (2, 19, 1.0, 1000), (3, 4, 3e6, 40), (4, 3, 0.02, 7)])
def test_hard_negatives(spark, seed, dim, size, shard):
    rows = vectors(seed, 120, dim, size)
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, rank string, kind int, shard int, score int").repartition(3)
    got = hardnegatives.hard_negatives(df, positives=4, negatives=2, every=5, shard_rows=shard)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 5, 4, 2)


def test_scan_drops_columns_and_rows_early():
    r = np.random.default_rng(5)
    raw = np.concatenate([r.normal(0, 0.01, (2000, 32)), r.normal(0, 1, (40, 32))])
    shard = hardnegatives.Columns({"label": np.zeros(2040, np.int64), "id": np.arange(2040), "rid": np.arange(2040), "v": raw})
    seen = []

    def keep(lower, upper):
        seen.append(len(lower))
        return hardnegatives.best_of(5)(lower, upper)

    at, query = shard.ready_for(raw[-1])
    rows, scores = at.scan(query, np.arange(2039), np.array([0]), keep)
    exact = np.floor(256 * raw[:2039]) @ np.floor(256 * raw[-1])
    assert set(np.argsort(-exact)[:5]) <= {int(at.rids[i]) for i in rows} and seen[-1] < 60 < seen[0]


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardnegatives.hard_negatives(empty).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hardnegatives.hard_negatives(alone).count() == 0


def test_scores_near_and_beyond_a_long(spark):
    shape = "vec_id long, embedding array<double>, label int"
    big = [(0, [float(2**22 - 1), 1.0], 1), (1, [float(2**24), 3.0], 1), (2, [float(2**23) + 1 / 256, 5.0], 2), (3, [float(2**23), 5.0], 2)]
    assert sorted(map(tuple, hardnegatives.hard_negatives(spark.createDataFrame(big, shape), every=50).collect())) == brute_negatives(big, 50, 5, 3)
    far = spark.createDataFrame([(0, [1e300], 1), (1, [1e300], 1)], shape)
    with pytest.raises(Exception):
        hardnegatives.hard_negatives(far).collect()


def test_segment_tree_gives_leftmost_lowest_pair():
    r = random.Random(3)
    leaf = lambda x, i: wordbpe._NONE if x is None else x << 32 | i
    for n in (1, 2, 3, 7, 20):
        ranks = [r.choice([None, 1, 2, 3]) for _ in range(n)]
        tree = wordbpe.lowest_pairs([leaf(x, i) for i, x in enumerate(ranks)])
        for _ in range(40):
            assert tree[1] == min(leaf(x, i) for i, x in enumerate(ranks))
            i = r.randrange(n)
            ranks[i] = r.choice([None, 0, 1, 5])
            wordbpe.put(tree, (i, leaf(ranks[i], i)))


def texts():
    r = random.Random(8)
    out = [None, "", " \t\n", "Hello, World's 123", "<|endoftext|>x<|startoftext|><|endoftext|> <|endoftext", "x\x1cy\x85z w", "İI ΣΑΣ ß é ̈a", "a" * 30_000, "ab" * 400 + "é🙂 " * 20_000, "same", "same"]
    ranges = [(32, 127), (9, 14), (32, 0x250), (0x250, 0xD7FF), (0x1F300, 0x1F700), (0x300, 0x36F)]
    return out + ["".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randrange(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("cached", [400_000, 5])
def test_word_bpe_equals_the_library(spark, cached):
    rows = [(None if i == 4 else i, t, "x", 1, b"y") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string, n_tokens int, decoded binary").repartition(4)
    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False).encode()))
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in wordbpe.encode_decode(df, WORDS, cached_words=cached, cached_stretches=cached).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert wordbpe.encode_decode(df.limit(0), WORDS).count() == 0


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            body = f"{len(role or '')}:{role or ''}{text or ''}"
            own[c].append((turn is not None, turn or 0, hashlib.sha256(body.encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in made.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = []
    for p, mine in members.items():
        below = [q for q in members if q[: len(p)] == p]
        inner = {q[:-1] for q in below if q}
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in mine if made[c] == p)))
        out.append((min(mine), len(p), min(members[p[:-1]]) if p else None, len(mine), sum(len(q) == len(p) + 1 for q in below), sum(q not in inner for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed):
    r, rows = random.Random(seed), []
    for c in [*r.sample(range(-12, 40), 22), None]:
        turns = list(range(r.choice([1, 2, 3, 5, 8, 9, 12, 17, 24, 33])))
        r.shuffle(turns)
        for t in turns:
            rows.append((c, None if t == 0 and r.random() < 0.3 else t + 1, r.choice(["u", None, "a"]) if r.random() < 0.2 else "u", r.choice(["é", "xx", None, ""]) if r.random() < 0.3 else "tt"))
    rows += [rows[0], rows[0], (50, 1, "u", "z" * 100_000), (50, 1, "u", "y"), (50, 1, "a", "y")]
    return rows + [(c, 1, "system", "be brief") for c in range(100, 160)]


@pytest.mark.parametrize("seed,long,block", [(0, 50_000, 8), (1, 6, 2), (2, 50_000, 3), (3, 4, 8)])
def test_prefix_trie(spark, monkeypatch, seed, long, block):
    monkeypatch.setattr(prefixtrie, "LONG", long)
    monkeypatch.setattr(prefixtrie, "PIECE_IDS", 16)
    rows = talks(seed)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos string, len int, blk int").repartition(3)
    got = prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.ordered_turns(df)), block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_prefix_trie_of_turnless_conversations_and_of_none(spark):
    shape = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], shape)
    assert prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.ordered_turns(empty))).count() == 0
    alone = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1][:7]
    rows = [(c, 0, "u", f"t{c}") for c in alone]
    got = prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.ordered_turns(spark.createDataFrame(rows, shape)))).collect()
    assert [tuple(r) for r in got] == brute_trie(rows) and got[0]["n_leaves"] == 1


def test_one_long_conversation_is_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "LONG", 100)
    rows = [(0, i, "u", f"t{i % 7}") for i in range(400)] + [(1, i, "u", f"t{i % 7}") for i in range(390)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr("reelcost.core.ordered.block_count", lambda _: 4)
    got = prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.ordered_turns(df)))
    assert got.agg(F.count("*"), F.max("depth"), F.sum("n_leaves")).first() == (401, 400, 401)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_stretches_seen_before_are_not_coded_again(monkeypatch):
    coder, coded = wordbpe.Coder(WORDS), []
    monkeypatch.setattr(coder, "codes", lambda text: coded.append(text) or [])
    raw = " ".join(map(str, range(190_000))).encode()
    assert coder.text(raw) == coder.text(raw)
    assert len(coded) == 190_000


def test_stretches_of_several_texts_are_told_apart_before_they_are_coded(monkeypatch):
    coder, coded = wordbpe.Coder(WORDS, 2, 2), []
    plain, codes = wordbpe.Coder(WORDS), coder.codes
    monkeypatch.setattr(coder, "codes", lambda text: coded.append(text) or codes(text))
    texts = ["One two three four five six é", "", "six five\tÉTÉ's four  ", "<|endoftext|> three two one x"] * 50
    raw = " ".join(texts).encode()
    assert coder.text(raw) == plain.text(raw)
    assert sorted(coded) == sorted(set(raw.decode().split()))
    one = [plain.text(t.encode()) for t in texts]
    counts, ids, tokens = plain.texts(pa.array(["gone", *texts]).slice(1))
    assert list(zip(counts.tolist(), ids.to_pylist(), tokens.to_pylist())) == one
