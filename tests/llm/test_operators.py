"""Corpus operators against brute force, on hand-made rows with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from reelcost.core.session import ship_package
from reelcost.llm import blocknames, bytepairs, chaining, credentials, kdsearch, ordinal, packing, setjoin, sitebayes, urlmodel

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    base = words(1, 200)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "x"), (4, "x "), (5, " ".join(base)), (6, "\n".join(base)), (7, "  ".join(base) + " "), (8, "é🙂 " * 3000), (8, "é🙂 " * 3000)]
    for i in range(30):
        w = list(base)
        for j in random.Random(i).sample(range(200), i % 8):
            w[j] = f"edit{i}x{j}"
        out.append((20 + i, " ".join(w)))
    out += [(60 + i, " ".join(words(100 + i, 30) + base[40:110] + words(200 + i, 300))) for i in range(6)]
    out.append((90, "password = hunter22 AKIA" + "A1B2" * 5 + " " + "0f" * 13 + " secret=ab"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, name string, h int, c int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_duplicates(docs, rows, bits):
    got = blocknames.duplicates(docs, block_chars=16 if bits == 2 else 64, hash_bits=bits).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    assert len(got) == len(rows)
    want = sorted((i, min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert blocknames.without_duplicates(docs).count() == len(groups)
    assert blocknames.without_duplicates(docs).columns == docs.columns


def test_shingle_join(docs, rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    for rare in (64, 2):
        got = setjoin.near_duplicates(docs, rare_df=rare).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), label[i]) for i, s in sets.items()}


def test_passages(docs):
    got = chaining.repeated_passages(docs).collect()
    assert {60, 61, 62, 63, 64, 65} <= {r.doc_id for r in got} | {r.ref_doc_id for r in got}
    assert all(min(r.end_word - r.start_word, r.ref_end - r.ref_start) >= 50 for r in got)
    assert not {90, 0, 1, 2, 3} & {r.doc_id for r in got}


def _alike_in_place(a, b):
    """Brute force: a stretch of 50 or more words on one diagonal with 80 % equal words."""
    for d in range(-len(a), len(b)):
        equal = [a[i] == b[i + d] for i in range(max(0, -d), min(len(a), len(b) - d))]
        if sum(equal) < 40:
            continue
        sums = np.concatenate([[0], np.cumsum(np.array(equal) * 5 - 4)])
        if any(sums[j] >= sums[: j - 49].min() for j in range(50, len(sums))):
            return True
    return False


def test_fuzzy_passages_against_brute_force(spark):
    r, rows, i = random.Random(8), [], 0
    for n, share in itertools.product((52, 70, 100), (0.05, 0.1, 0.15, 0.2)):
        for way in ("random", "even"):
            passage = words(1000 + i, n)
            step = round(1 / share)
            changed = set(range(step - 1, n, step)) if way == "even" else set(r.sample(range(n), int(n * share)))
            other = [f"new{i}x{j}" if j in changed else w for j, w in enumerate(passage)]
            rows.append((2 * i, " ".join(words(2000 + i, 90) + passage + words(3000 + i, 70))))
            rows.append((2 * i + 1, " ".join(words(4000 + i, 40) + other + words(5000 + i, 100))))
            i += 1
    want = {(b[0], a[0]) for a, b in zip(rows[::2], rows[1::2]) if _alike_in_place(a[1].split(), b[1].split())}
    assert len(want) >= 20
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert want <= {(x.doc_id, x.ref_doc_id) for x in got}
    texts = {k: t.split() for k, t in rows}
    for x in got:
        assert min(x.end_word - x.start_word, x.ref_end - x.ref_start) >= 50 and x.identity >= 0.8
        if x.end_word - x.start_word == x.ref_end - x.ref_start:
            a, b = texts[x.doc_id][x.start_word : x.end_word], texts[x.ref_doc_id][x.ref_start : x.ref_end]
            assert sum(map(str.__eq__, a, b)) >= x.equal_words


def test_exact_passages_behind_truncated_copies(spark):
    rows, i = [], 0
    for n, heads in ((52, [45]), (60, [45]), (52, [40]), (70, [45, -45]), (50, [49, -49])):
        passage = words(6000 + i, n)
        parts = [passage[:h] if h > 0 else passage[h:] for h in heads]
        # The parts stand in earlier and in later documents, so that they are the first and last holders of all short seeds.
        for part in [*parts, passage, passage, *parts]:
            rows.append((len(rows), " ".join(words(7000 + 2 * len(rows), 60) + part + words(7001 + 2 * len(rows), 60))))
        i += 1
    held = {k: {tuple(w[j : j + 50]) for j in range(len(w) - 49)} for k, t in rows for w in [t.split()]}
    want = {(b, a) for a, b in itertools.combinations(held, 2) if held[a] & held[b]}
    assert len(want) == 5
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert want <= {(r.doc_id, r.ref_doc_id) for r in got if r.identity == 1 and r.end_word - r.start_word >= 50}


def test_chains_are_optimal():
    r = random.Random(3)
    for _ in range(20):
        pts = sorted({(4 * r.randint(0, 15), 4 * r.randint(0, 15)) for _ in range(14)})
        p, q = [a for a, _ in pts], [b for _, b in pts]
        best = [0.0] * len(pts)
        for i in range(len(pts)):
            best[i] = 4.0
            cand = [(best[j] + 0.1 * (p[j] + q[j]), j) for j in range(i) if p[j] < p[i] and q[j] < q[i]]
            top = max((v for v, _ in cand), default=0) - 0.1 * (p[i] + q[i])
            if cand and top > 0:
                j = max(cand)[1]
                best[i] = top + min(4, p[i] - p[j], q[i] - q[j])
        got = chaining.chains(p, q, 4, 0.1, 1)
        assert sorted(i for c in got for i in c) == list(range(len(pts)))
        first = got[0]
        assert all(p[a] < p[b] and q[a] < q[b] for a, b in zip(first, first[1:]))
        score = 4.0 * len(first) - 0.1 * (p[first[-1]] - p[first[0]] + q[first[-1]] - q[first[0]])
        assert abs(score - max(best)) < 1e-9


def test_packing(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    for ranks in (None, public_tokenizers.path("byte_bpe_50k.tiktoken")):
        got = packing.pack(docs, path, ranks, group_docs=16, with_ids=True).collect()
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        for s in sequences.values():
            s.sort()
            assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s[:-1]])) and sum(n for _, n in s) <= 1024
        texts = dict(rows)
        for i in texts:
            ids = tok.encode(texts[i] or "", add_special_tokens=False).ids + [0]
            own = sorted((r.start, bytes(r.ids)) for r in got if r.doc_id == i)
            assert b"".join(dict(own).values()) == np.array(ids, "<u4").tobytes()
    assert packing.first_fit_decreasing([6, 5, 5, 4], 10)[0].tolist() == [0, 1, 1, 0]


def test_byte_pairs(docs, rows):
    ranks = bytepairs.read_ranks(RANKS)
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    got = bytepairs.encode_decode(docs, RANKS, public_tokenizers.PATTERN, cached_words=10).collect()
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    few = docs.filter("doc_id in (0, 1, 2, 3, 20, 90)")
    native = bytepairs.encode_decode_native(few, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in native) == [w for w in want if w[0] in (0, 1, 2, 3, 20, 90)]
    long = bytes(random.Random(5).choice(b"abcdethin") for _ in range(3000))
    assert bytepairs.merged(long, ranks) == enc._encode_single_piece(long)


def test_credentials(docs, spark):
    row = credentials.report(docs.filter("doc_id = 90")).first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 1)
    assert row.spans.startswith("assign:0:19,access:20:44,hex:45:71")
    apart = "login: someone" + " word" * 100 + " https://host.example/path"
    near = "login: someone at https://host.example/path key Ab3" + "dEf4" * 6
    got = credentials.report(spark.createDataFrame([(1, apart), (2, near), (3, None)], "doc_id long, text string")).collect()
    spans = {r.doc_id: r.spans for r in got}
    assert spans[1] == "" and spans[3] == "" and {s.split(":")[0] for s in spans[2].split(",")} == {"identity", "material"}
    masked = credentials.redacted(docs.filter("doc_id in (90, 0, 3)")).collect()
    texts = {r.doc_id: r.text for r in masked}
    assert texts[0] is None and texts[3] == "x" and "hunter22" not in texts[90] and texts[90].count("[secret]") == 3


def test_long_credentials_and_gaps(spark):
    key = "aB3" + "xY7z" * 22
    gap = lambda n: "\n" + "-" * (n - 2) + "\n"
    texts = [f"account: someone {key}==", f"https://h.example/{'p' * 400}" + gap(200) + key, f"https://h.example/{'p' * 400}" + gap(201) + key, key + gap(200) + "login: someone", key + gap(201) + "login: someone"]
    r = random.Random(4)
    for _ in range(30):
        texts.append("".join(r.choice([key, key[:30], "login: someone", "https://h.example/" + "p" * r.randint(1, 500), "AKIA" + "A1B2" * 5]) + gap(r.randint(2, 450)) for _ in range(5)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: {tuple(s) for s in x.spans} for x in credentials.scan(rows).collect()}
    masked = {x.doc_id: x.text for x in credentials.redacted(rows).collect()}
    for i, t in enumerate(texts):
        base = credentials.base_spans(t)
        weak = credentials.weak_spans(t, base)
        want = {w for w in weak if any(k in credentials.CONFIRMS[w[0]] and max(s - w[2], w[1] - e) <= 200 for k, s, e in base + weak)} | set(base)
        assert got[i] == want, i
        hidden = [any(s <= at < e for _, s, e in want) for at in range(len(t))]
        assert "".join(c for c, h in zip(t, hidden) if not h) == masked[i].replace("[secret]", ""), i
    kinds = [sorted(k for k, _, _ in got[i]) for i in range(5)]
    assert [("material" in k) for k in kinds] == [True, True, False, True, False]


def test_url_scores_from_all_ruled_urls(spark):
    rules = [urlmodel.Rule("allow", "org", "/"), urlmodel.Rule("block", "com", "/")]
    ruled = [f"https://o{i * i}.org/{chr(97 + i % 26)}{i}" for i in range(25)] + [f"https://c{i}.com/{chr(122 - i % 26)}x{i}" for i in range(25)]
    free = [u.replace(".org", ".net").replace(".com", ".net") for u in ruled]
    got = urlmodel.judged(spark.createDataFrame(list(enumerate(ruled + free)), "page_id long, url string"), rules).collect()
    counts = {True: {}, False: {}}
    for u in ruled:
        s = "\x02" + u
        for i in range(1, len(s)):
            for k in range(min(i, 5) + 1):
                c = counts[".org/" in u].setdefault(s[i - k : i], {})
                c[s[i]] = c.get(s[i], 0) + 1

    def p(side, ctx, c):
        out = 1 / 256
        for k in range(len(ctx) + 1):
            own = counts[side].get(ctx[len(ctx) - k :])
            out = (own.get(c, 0) + len(own) * out) / (sum(own.values()) + len(own)) if own else out
        return out

    for r in got:
        if r.page_id >= len(ruled):
            s = "\x02" + free[r.page_id - len(ruled)]
            want = np.mean([np.log(p(True, s[max(0, i - 5) : i], s[i])) - np.log(p(False, s[max(0, i - 5) : i], s[i])) for i in range(1, len(s))])
            assert abs(r.score - want) < 1e-9


def test_url_models(spark):
    rules = [urlmodel.Rule("allow", "org", "/"), urlmodel.Rule("block", "example.org", "/es/"), urlmodel.Rule("block", "com", "/de/")]
    urls = [f"https://a{i}.Example.ORG/good/{i}" for i in range(60)] + [f"http://x{i}.com/de/spam{i}" for i in range(60)]
    urls += ["https://b.net/good/7", "http://y.net/de/spam9", None, "", "no scheme", "http://example.org/es/1?q", "http://org", "http://org/?", "HTTP://ORG/x#y"]
    got = urlmodel.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(urls) and by[120].verdict == "allow" and by[121].verdict == "block"
    assert (by[122].host, by[122].path, by[125].rule, by[125].verdict) == ("", "", "example.org/es/", "block")
    assert (by[126].path, by[126].rule, by[127].rule, by[128].host) == ("", None, "org/", "org")


def alike_pair(a, b, min_words=50, min_identity=0.8):
    """Brute force: is there a stretch on any diagonal long and alike enough?"""
    a, b = np.array(a), np.array(b)
    for d in range(-len(a) + min_words, len(b) - min_words + 1):
        lo, hi = max(0, -d), min(len(a), len(b) - d)
        sums = np.concatenate([[0.0], np.cumsum((a[lo:hi] == b[lo + d : hi + d]) - min_identity)])
        low = np.minimum.accumulate(sums)
        if (np.arange(len(sums)) - np.searchsorted(-low, -sums - 1e-9)).max() >= min_words:
            return True
    return False


def test_passages_between_first_and_last_holders_of_their_parts(spark):
    """The halves of a passage stand in earlier and later documents too, which share too little to be reported."""
    rng = np.random.default_rng(11)
    junk = lambda n: [f"j{x}" for x in rng.integers(0, 10**9, n)]
    whole = [f"w{i}" for i in range(60)]
    changed = [w if i % 9 else f"c{i}" for i, w in enumerate(whole)]
    texts = [whole[:30], whole[30:], changed[:30], changed[30:], whole, changed, whole[:30], whole[30:], changed[:30], changed[30:]]
    df = spark.createDataFrame([(i, " ".join(junk(40) + t + junk(40))) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = [(x.doc_id, x.ref_doc_id, x.identity) for x in chaining.repeated_passages(df).collect()]
    assert [(x[0], x[1]) for x in got] == [(5, 4)] and 0.85 < got[0][2] < 0.95
    # A passage in many documents is reported for every pair of them.
    df = spark.createDataFrame([(i, " ".join(junk(10) + whole + junk(10))) for i in range(40)], "doc_id long, text string").repartition(3)
    got = {(x.doc_id, x.ref_doc_id) for x in chaining.repeated_passages(df).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i)}


def test_matches_of_pieces_are_all_pairs(monkeypatch):
    monkeypatch.setattr(chaining, "BLOCK", 5)
    monkeypatch.setattr(chaining, "PIECE", 20)
    rng = np.random.default_rng(4)
    for n, seeds, docs_ in ((0, 1, 1), (1, 1, 1), (60, 1, 3), (80, 4, 30), (200, 60, 9), (50, 50, 1)):
        seed, doc, pos = rng.integers(0, seeds, n).astype(np.uint64) << np.uint64(1), rng.integers(-3, docs_, n), np.arange(n, dtype=np.int32)
        order = np.lexsort((pos, doc, seed))
        seed, doc, pos = seed[order], doc[order], pos[order]
        got, total = [], 0
        for matches, apart, raw in chaining._pieces(seed, doc, pos):
            step, d, p = chaining._numbers(raw, chaining._OCCURRENCE)
            found = [f for turn in range(3) for f in chaining._matched(np.cumsum(step, dtype=np.uint64), d, p, apart, turn, 3)]
            assert sum(len(f[0]) for f in found) <= matches and all(len(f[0]) <= 20 + 200 for f in found)
            got += [m for f in found for m in zip(*[c.tolist() for c in f[:4]])]
            total += matches
        want = [(int(doc[i]), int(doc[j]), int(pos[i]), int(pos[j])) for i in range(n) for j in range(n) if seed[i] == seed[j] and doc[i] > doc[j]]
        assert sorted(got) == sorted(want) and total >= len(want)


def test_recall_of_planted_variants(spark):
    r, groups, docs_ = random.Random(17), [], []
    for size in (52, 70, 100):
        for share in (0.06, 0.08, 0.1):
            for _ in range(2):
                base, group = words(r.random(), size), []
                for _ in range(6):
                    w = list(base)
                    for j in r.sample(range(size), round(share * size)):
                        w[j] = f"new{r.random()}"
                    group.append(len(docs_))
                    docs_.append(words(r.random(), r.randint(20, 120)) + w + words(r.random(), r.randint(20, 120)))
                groups.append(group)
    exact = words(r.random(), 50)
    repeats = [len(docs_), len(docs_) + 1]
    docs_ += [words(r.random(), 60) + exact + words(r.random(), 30), words(r.random(), 20) + exact]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs_)], "doc_id long, text string").repartition(4)
    got = {(x.ref_doc_id, x.doc_id) for x in chaining.repeated_passages(df).collect()}
    want = {p for g in groups for p in itertools.combinations(g, 2) if alike_pair(docs_[p[0]], docs_[p[1]])}
    assert tuple(repeats) in got and all(any(set(p) <= set(g) for g in [*groups, repeats]) for p in got)
    # Documents of a group, all linked through its anchors.
    linked = 0
    for g in groups:
        reach, todo = set(), [g[0]]
        while todo:
            x = todo.pop()
            if x not in reach:
                reach.add(x)
                todo += [b if a == x else a for a, b in got if x in (a, b)]
        linked += sum(set(p) <= reach for p in want if set(p) <= set(g))
    assert len(want) > 200 and len(want & got) / len(want) >= 0.95 and linked / len(want) >= 0.98


def test_top_k(spark):
    r = np.random.default_rng(2)
    vectors = [[float(x) for x in r.normal(size=6)] for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[3]), (300, vectors[3]), (400, None), (450, [1.0, None]), (500, [float("nan")] * 6), (None, vectors[1]), (550, [2.0])]
    got = kdsearch.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=64).collect()
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for a, (i, v) in enumerate(good):
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for b, (j, w) in enumerate(good) if a != b and len(v) == len(w))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("size,shard", [(4e5, 64), (7e5, 16), (1e6, 1000)])
def test_top_k_of_large_components(spark, size, shard):
    r = random.Random(int(size))
    rows = [(i, [round(r.gauss(0, 1), 3) * (size if i % 3 else 1.0) for _ in range(5)]) for i in range(120)] + [(500, []), (501, []), (550, [1e300]), (551, [0.0])]
    df = spark.createDataFrame([(*x, 1, 2, "s", 3, 4) for x in rows], "vec_id long, embedding array<double>, rank int, score int, shard string, kind int, floor int").repartition(3)
    whole = [[math.floor(256 * x) if abs(x) < 2**52 else int(x) * 256 for x in v] for _, v in rows]
    want = []
    for a, (i, v) in enumerate(rows):
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(whole[a], whole[b])), j) for b, (j, w) in enumerate(rows) if a != b and len(v) == len(w))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = kdsearch.top_k(df, shard_rows=shard)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert max(abs(x[3]) for x in want) > 2**40
    far = spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception):
        kdsearch.top_k(far).collect()


def test_toxicity_and_quality(spark):
    r = random.Random(1)
    rows = [(i, " ".join(words(i, 40) + ["idiot"] * (i % 4 == 0) * (1 + i % 3) + ["!!!"] * (20 if i % 5 == 0 else 0)), f"s{i % 3}") for i in range(300)] + [(900, None, None), (901, "", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 5 != 0)) for i in range(200)], "doc_id long, toxic int, quality int")
    model = ordinal.fit(docs, labels)
    got = {x.doc_id: x for x in ordinal.scored(docs, model).withColumn("bad", ordinal.is_toxic(model)).collect()}
    assert all(got[i].bad == (i % 4 == 0) for i in range(300)) and not got[900].bad and not got[901].bad
    assert not ordinal.scored(docs, ordinal.fit(docs, labels.filter("toxic = 0"))).filter(ordinal.is_toxic(ordinal.Model())).count()
    q = {x.doc_id: x for x in sitebayes.quality(docs, labels, F.col("source"), F.col("source")).collect()}
    assert len(q) == 302 and np.mean([q[i].keep == (i % 5 != 0) for i in range(200, 300)]) > 0.95
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 50)
    w, cuts = ordinal.fit_cumulative_link(x, np.array([0, 0, 1, 2] * 50), 3)
    assert w[0] > 0 and cuts[0] < cuts[1] and r


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert blocknames.duplicates(empty).count() == 0
    assert setjoin.near_duplicates(empty).count() == 0
    assert chaining.repeated_passages(empty).count() == 0
    assert credentials.report(empty).count() == 0
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert bytepairs.encode_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert ordinal.scored(empty, ordinal.fit(empty, labels)).count() == 0
    assert sitebayes.quality(empty, labels, F.lit("a"), F.lit("b")).count() == 0
    assert urlmodel.judged(spark.createDataFrame([], "page_id long, url string"), []).count() == 0
    assert kdsearch.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, sf).checkpoint()
        assert seen.columns == docs.columns, name
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == seen.count()
