"""Fits, posteriors, spans, bins and the stages in a row against plain versions."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelcost.core.session import ship_package
from reelcost.llm import common, credentials, ordinal, packing, setjoin, sitebayes

WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def either_case(name):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)


ASSIGN = re.compile("(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return found + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]


def plain_spans(text):
    base = plain_base(text)
    weak = credentials.weak_spans(text, base)
    return base + [w for w in weak if any(k in credentials.CONFIRMS[w[0]] and max(s - w[2], w[1] - e) <= credentials.SCOPE for k, s, e in base + weak)]


def test_base_spans_are_those_of_the_literal_patterns():
    pieces = ["password", "PassWd", "secret", "ſecret", "token", "TOKEN", "api_key", "apikey", "Api_Key", ":", "=", " ", "  ", '"', "'", "\t", "\n", "AKIA", "A1B2C3D4E5F6G7H8", "abc", "hunter22", "0123456789abcdef", "f" * 23, "deadbeef" * 3, "é", "🙂", "+/_.=-", "x" * 5, "G"]
    r = random.Random(11)
    hits = 0
    for _ in range(20_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        want = plain_base(text)
        hits += len(want)
        assert sorted(credentials.base_spans(text)) == sorted(want), text
    assert hits > 5_000


def test_first_fit_decreasing_by_trying_every_bin():
    r = random.Random(12)
    for case in range(300):
        cap = r.choice([1, 7, 64, 1024])
        sizes = [r.randint(1, cap) for _ in range(r.randint(0, 60))]
        free, bins, offsets = [], [0] * len(sizes), [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((b for b, room in enumerate(free) if room >= sizes[i]), len(free))
            if at == len(free):
                free.append(cap)
            bins[i], offsets[i] = at, cap - free[at]
            free[at] -= sizes[i]
        got = packing.first_fit_decreasing(sizes, cap)
        assert (got[0].tolist(), got[1].tolist()) == (bins, offsets), case
    sizes = [r.randint(1, 1023) for _ in range(8192)]
    used = packing.first_fit_decreasing(sizes, 1024)[0].max() + 1
    assert sum(sizes) / (1024 * used) > 0.98


def test_cumulative_link_fit_is_at_its_optimum():
    rng = np.random.default_rng(13)
    x = rng.poisson(0.7, (400, 3)).astype(float)
    noisy = x @ np.array([1.5, 0.8, 0.0]) + rng.logistic(size=400)
    grade = (noisy > 1.5).astype(int) + (noisy > 3.5)
    ridge = 1e-3

    def loss(w, cuts):
        total = 0.0
        for row, g in zip(x, grade):
            below = [0.0, *(1 / (1 + np.exp(-(c - row @ w))) for c in cuts), 1.0]
            total -= np.log(below[g + 1] - below[g])
        return total / len(x) + ridge * float(w @ w) / 2

    w, cuts = ordinal.fit_cumulative_link(x, grade, 3, ridge)
    assert cuts[0] < cuts[1] and (w >= 0).all()
    here = loss(w, cuts)
    for size in (0.01, 0.05, 0.2):
        for i, sign in itertools.product(range(5), (-1, 1)):
            p = np.concatenate([w, cuts])
            p[i] += sign * size
            assert loss(np.maximum(p[:3], 0), p[3:]) > here - 1e-5
    model = ordinal.Model({}, list(cuts))
    for s in (-3.0, 0.0, 2.5, 8.0):
        below = [0.0, *(1 / (1 + np.exp(-(c - s))) for c in cuts), 1.0]
        share = np.diff(below)
        assert model.severity(np.array([s]))[0] == pytest.approx(float(share @ np.arange(3)))
        assert model.grade(np.array([s]))[0] == int(np.argmax(share))


def plain_score(model, text):
    every = [w.lower() for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    marks = [w for w in every] + [w[:k] + "*" for w in every for k in ordinal.PREFIXES if len(w) > k]
    return sum(model.weights[f] * (1 + np.log1p(100 * marks.count(f) / len(every))) for f in set(marks) if f in model.weights)


def test_scores_of_texts_with_repeats_clashes_and_long_texts(spark):
    model = ordinal.Model({"idiot": 1.3, "idio*": 0.4, "scum": 2.0}, [1.0, 2.5], 0.9)
    texts = ["You IDIOT, idiots!", "scum " * 5 + "fine", "calm words", None, "", "idiot", "idiot", "clean word " * 50_000 + "scum"]
    rows = [(i, t, 5.0, "k") for i, t in enumerate(texts)]
    got = ordinal.scored(spark.createDataFrame(rows, "doc_id long, text string, severity double, __s string").repartition(3), model)
    assert got.columns == ["doc_id", "text", "severity", "__s", "__severity", "__grade"]
    for r in got.collect():
        s = np.array([plain_score(model, r.text)])
        assert r["__severity"] == pytest.approx(model.severity(s)[0], rel=1e-9) and r["__grade"] == model.grade(s)[0]
        assert (r.severity, r["__s"]) == (5.0, "k")


def test_site_posteriors_by_hand(spark):
    r = random.Random(14)
    sites = [("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("c", None), (None, None)]
    rows = []
    for i in range(240):
        host, path = r.choice(sites[:1] * 6 + sites)
        good = r.random() < (0.8 if host == "a" else 0.3)
        text = None if i == 7 else "" if i == 8 else " ".join("word%d" % r.randint(0, 40) for _ in range(30)) + ("." if good else " !!!" * 9)
        rows.append((i, text, host, path, int(good), 1.0))
    rows += rows[:5]
    docs = spark.createDataFrame([(*q[:4], q[5]) for q in rows], "doc_id long, text string, host string, path string, s double").repartition(4)
    labels = spark.createDataFrame([(q[0], q[4]) for q in rows[:120]], "doc_id long, quality int")
    got = sitebayes.quality(docs, labels, F.col("host"), F.col("path")).toPandas().astype({"host": object, "path": object})
    assert len(got) == 245
    key = lambda v: None if v != v else v
    found = [(key(h), key(p), d) for h, p, d in zip(got.host, got.path, got.document_p)]
    mu = np.mean([d for _, _, d in found])

    def strength(groups, prior):
        big = {g: v for g, v in groups.items() if len(v) > 1}
        n = sum(map(len, big.values()))
        spread = sum(len(v) * (np.mean(v) - prior(g)) ** 2 for g, v in big.items())
        noise = sum(prior(g) * (1 - prior(g)) for g in big)
        free = sum(len(v) * prior(g) * (1 - prior(g)) for g, v in big.items())
        return min(max(free / n / max((spread - noise) / n, 1e-9) - 1, 1.0), 1e6)

    hosts, paths = {}, {}
    for h, p, d in found:
        hosts.setdefault(h, []).append(d)
        paths.setdefault((h, p), []).append(d)
    kh = strength(hosts, lambda g: mu)
    host_p = {h: (kh * mu + sum(v)) / (kh + len(v)) for h, v in hosts.items()}
    kp = strength(paths, lambda g: host_p[g[0]])
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for (h, p, d), hp, pp, qp, keep in zip(found, got.host_p, got.path_p, got.quality_p, got.keep):
        v = paths[h, p]
        others = (kp * host_p[h] + sum(v) - d) / (kp + len(v) - 1)
        want = 1 / (1 + np.exp(-(logit(d) + logit(others) - logit(mu))))
        assert (hp, pp, qp) == pytest.approx((host_p[h], (kp * host_p[h] + sum(v)) / (kp + len(v)), want), rel=1e-6)
        assert keep == (qp >= 0.5)


def test_logistic_fit_is_at_its_optimum():
    rng = np.random.default_rng(15)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.1, 2] + 3
    y = (x[:, 0] + rng.logistic(size=300) > 3).astype(float)
    mean, scale, w = sitebayes.fit_logistic(x, y)
    z = np.column_stack([(x - mean) / scale, np.ones(300)])

    def loss(v):
        return float(np.logaddexp(0, -(2 * y - 1) * (z @ v)).sum() + 0.5 * v[:-1] @ v[:-1])

    for i, step in itertools.product(range(5), (-1e-3, 1e-3)):
        moved = w.copy()
        moved[i] += step
        assert loss(moved) > loss(w) - 1e-9


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_in_a_row(spark, tmp_path):
    r = random.Random(16)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(400)]
    rows = []
    for i in range(150):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        if i % 5 == 0:
            for _ in range(6):
                words[r.randrange(len(words))] = "idiot"
        if i % 7 == 0:
            words += ["password=hunter22x", "login:", "someone", "Ab3" + "dEf4" * 6]
        rows.append((i, " ".join(words)))
    for i in range(150, 190):
        words = rows[r.randrange(150)][1].split(" ")
        for _ in range(i % 4):
            words[r.randrange(len(words))] = "edited"
        rows.append((i, ("  " if i % 2 else " ").join(words)))
    rows += [rows[3], rows[3], (190, None), (191, ""), (192, " \n"), (193, "é🙂 " * 2000), (194, "one two"), (195, "one  two "), (None, "a text without an id"), (196, "word " * 30_000)]
    clashing = "n long, c string, __s string, __severity int, __id int, __key string"
    table = [(i, t, "en", "hot", len(t) if t is not None else None, 1, None, "l", 2, None, "t") for i, t in rows]
    docs = spark.createDataFrame(table, f"doc_id long, text string, lang string, source string, n_chars long, {clashing}")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(150)], "doc_id long, toxic int, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    model = ordinal.fit(docs, labels)
    left = [(i, t) for i, t in rows if model.severity(np.array([plain_score(model, t)]))[0] < model.reject_from]
    assert len(left) < len(rows) - 25 and {i for i, _ in left} >= {i for i in range(150) if i % 5}
    best = {}
    for i, t in left:
        name = re.sub(r"[\x20\x09-\x0d]", "", t or "")
        rank = (-len(t or ""), i is None, i or 0)
        if name not in best or rank < best[name][0]:
            best[name] = (rank, i, t)
    left = [(i, t) for _, i, t in best.values()]
    sets = {i: shingles(t) for i, t in left if i is not None}
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            group[b] = a
    before = len(left)
    left = [(i, t) for i, t in left if i is None or top(i) == i]
    assert len(left) < before

    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in left:
        out, at = [], 0
        for s, e in sorted((s, e) for _, s, e in plain_spans(t or "")):
            if s >= at:
                out += [t[at:s], "[secret]"]
            at = max(at, e)
        want[i] = tokens.encode("".join(out) + (t or "")[at:], add_special_tokens=False).ids + [0]
    got = {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(p.doc_id, []).append((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist()))
    assert set(got) == set(want)
    for i, parts in got.items():
        assert [x for _, ids in sorted(parts) for x in ids] == want[i], i


def test_words_and_shingles_are_hashed_in_little_memory():
    texts = ["Some words of \x0bText é " * 4_000, None, "", "one  two\nONE two one two x", "three of " * 3, "x" * 70_000 + " end", "y " * 200_000] * 5
    column = pa.array(["gone", *texts]).slice(1)
    tracemalloc.start()
    words, first = common.hashed_words(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * column.nbytes
    cut = [(t or "").lower().encode().split() for t in texts]
    assert np.diff(first).tolist() == [len(c) for c in cut]
    assert len(set(zip([w for c in cut for w in c], words.tolist()))) == len({w for c in cut for w in c}) == len(set(words.tolist()))
    for k in (4, 50):
        runs = common.hashed_runs(words, k)
        total = 0
        for w in words[1000 : 1000 + k].tolist():
            total = (total * int(common._BASE) + w) % 2**64
        assert common.mix(np.array([(total + k) % 2**64], np.uint64))[0] == runs[1000]
    flat, first = setjoin.shingle_sets(column)
    assert np.diff(first).tolist() == [len({tuple(c[i : i + 5]) for i in range(max(1, len(c) - 4))}) if c else 0 for c in cut]
    assert all((x[1:] > x[:-1]).all() for x in (flat[a:b] for a, b in zip(first, first[1:])))
