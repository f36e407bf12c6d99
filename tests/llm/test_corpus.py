"""Near-duplicates, quality rules, language-model scores, host graph and pipeline against brute force."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatlake.llm import common, host_graph, minhash, neural_lm, quality
from chatlake.llm.components import components
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingled(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def grouped(rows, size, percent=80):
    """Smallest linked id of every (id, text), all pairs compared."""
    sets = {i: shingled(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), len(sets[i])) for i in sets}


def test_near_duplicates_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.op2_minhash(spark, SF).collect()}
    assert got == grouped(rows, 2)


def test_dense_group_and_edges(spark, monkeypatch):
    """Copies at all distances, in blocks of few members: strays are settled in the second round."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one"), (4, "One"), (5, "a b"), (6, "A  b")]
    for i in range(40):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 6, 8])):
            w[rnd.randrange(60)] = f"x{rnd.random()}"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("clash"))
    for size in (2, 5):
        got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(df, size).collect()}
        assert got == grouped(rows, size)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_hot_classes_and_repeated_ids(spark, monkeypatch):
    """Broadcast hot classes, ids with several texts, null ids, ids kept beside the result."""
    monkeypatch.setattr(minhash, "joined", lambda rows, side, key: common.joined(rows, side, key, 5))
    rows = [(i, "the same text over and over") for i in range(50)] + [(i, None) for i in range(50, 70)]
    rows += [(7, "another text that has six words"), (90, "another text that has six words"), (None, "another text that has six words"), (None, "alone"), (7, "the same text over and over")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    got = {r.k: (r.doc_id, r.component_id, r.kept, r.group is None) for r in minhash.near_duplicates(df, 2, keys=("k",)).collect()}
    assert [got[k] for k in (0, 3, 55, 70, 71, 72, 73, 74)] == [
        (0, 0, True, False), (3, 0, False, False), (55, 55, True, True), (7, 7, True, False), (90, 7, False, False), (None, 7, True, False), (None, None, True, True), (7, 0, False, False),
    ]
    assert len(got) == len(rows)


def test_bands_miss_few_links():
    """The chance that a pair at similarity 0.8 shares no bucket, measured over made-up pairs."""
    rnd = np.random.default_rng(11)
    missed = 0
    for _ in range(400):
        both, a, b = (rnd.integers(0, 1 << 63, n, np.uint64) for n in (400, 50, 50))
        one, other = (minhash.buckets_of(minhash.signature(np.sort(np.concatenate([both, x])))[None]) for x in (a, b))
        missed += not (one == other).any()
    assert missed == 0


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def base_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, " \n\t\n"), (-4, "a a a a"), (-5, "a b"), (-6, "x\nx\n\nx\u00a0y 😀|"), (-7, "a b c " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in quality.statistics(df, ["doc_id"]).collect():
        want = base_statistics(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_rejects_outliers_only(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7)))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(60, 400))), "en", None if i % 2 else "a", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(100)), "en", "a", 0) for i in range(40)]
    rows += [(2000, " ".join(word() + "###" for _ in range(100)), "xx", "tiny", 0), (2001, None, None, None, 0)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(40))
    assert got[2000] and not got[2001]
    assert quality.judge(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0


def test_quality_judges_small_groups(spark):
    rnd = random.Random(9)
    text = lambda mark: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) + mark for _ in range(150))
    groups = [("en", "big", 60), ("en", "small", 6), ("en", None, 5), ("de", "x", 20), ("de", "y", 21), ("fr", "x", 9), ("fr", None, 4), (None, "x", 7), (None, None, 2)]
    rows = [(1000 * g + i, text(""), lang, source, 0) for g, (lang, source, n) in enumerate(groups) for i in range(n)]
    junk = [(1000 * g + 999, text("###"), lang, source, 0) for g, (lang, source, _) in enumerate(groups)]
    got = {r.doc_id: (r.kept, r.grp.level) for r in quality.judge(spark.createDataFrame(rows + junk, DOCS), ["doc_id"]).collect()}
    assert all(got[r[0]][0] for r in rows) and not any(got[r[0]][0] for r in junk)
    assert [got[1000 * g][1] for g in range(len(groups))] == [0, 1, 1, 1, 1, 2, 2, 2, 2]
    few = spark.createDataFrame([*rows[100:108], junk[0]], DOCS)
    assert [r.doc_id for r in quality.judge(few, ["doc_id"]).where("not kept").collect()] == [junk[0][0]]


def test_mcd_equals_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.round(np.abs(rng.normal(1, 0.5, (200, 4))), 3)
    x[:30] += 5
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, x0 double, x1 double, x2 double, x3 double")
    got = quality.mcd(df.select(F.struct("grp").alias("grp"), *quality.FEATURES)).first()
    floors = np.diag(np.square(quality.FLOORS))
    m = np.median(x, axis=0)
    c = np.diag(np.square(1.4826 * np.median(np.round(np.abs(x - m), 3), axis=0))) + floors
    found = []
    for m, c in ((m, c), (x.mean(axis=0), np.cov(x.T, bias=True) + floors)):
        low = np.inf
        for _ in range(100):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            ring = np.floor(np.log(d + 1e-6) * 200)
            near = x[ring <= np.quantile(ring, quality.H)]
            m2, c2 = near.mean(axis=0), np.cov(near.T, bias=True) + floors
            if np.linalg.slogdet(c2)[1] >= low - quality.SETTLED:
                break
            m, c, low = m2, c2, np.linalg.slogdet(c2)[1]
        found.append((low, len(found), m, c))
    _, _, m, c = min(found, key=lambda f: f[:2])
    assert np.allclose([got[f"m{i}"] for i in range(4)], m) and np.allclose([got[f"l{i}{j}"] for i in range(4) for j in range(i + 1)], np.linalg.cholesky(c)[np.tril_indices(4)])


def test_cutoff_is_the_tail_s_quantile():
    """Four normal features: the tail is exp(-x/2)(1 + x/2), and the nearest three quarters are narrower by a known factor."""
    x = quality._quantile(1e-3, 4)
    assert math.isclose(math.exp(-x / 2) * (1 + x / 2), 1e-3, rel_tol=1e-6) and math.isclose(x, 18.4668, rel_tol=1e-4)
    rng = np.random.default_rng(3)
    d = np.sort((rng.normal(size=(400_000, 4)) ** 2).sum(axis=1))
    inner = rng.normal(size=(400_000, 4))
    near = inner[np.argsort((inner**2).sum(axis=1))[: 300_000]]
    assert math.isclose(quality.cutoff_of(1e-3), d[-400] / near.var(), rel_tol=0.05)


def test_language_model(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(None, None), (10**6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = neural_lm.lm_scores(df).collect()
    assert len(got) == len(rows)
    tokens = {i: [*(t or "").encode().lower().split(), neural_lm.END] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if neural_lm.fold(i) != 2 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), total, neural_lm.fold(r.doc_id) == 2)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), abs_tol=1e-6)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert neural_lm.lm_scores(df.limit(0)).count() == 0


def test_op5_whole_query(spark):
    """The query's own columns, and held-out texts scored above the base."""
    rows = {r.doc_id: r for r in neural_lm.op5_neural_lm(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert set(rows) == {r.doc_id for r in docs}
    held = [r for r in rows.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.02 * sum(r.n_tokens for r in held)
    assert [f.name for f in neural_lm.op5_neural_lm(spark, SF).schema] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def stepped(ids, starts, times, seed=1):
    model = neural_lm.LogBilinear.start(np.bincount(ids, minlength=neural_lm.IDS))
    stepper = neural_lm.Stepper(model, seed)
    for _ in range(times):
        stepper.step(ids, starts)
    return model, stepper


def test_language_model_is_normalised_and_learns():
    """Over all words the probabilities sum to 1; a chain's next words are learnt by sampled noise."""
    rng = np.random.default_rng(8)
    some = np.array([0, 5, 9, 130, 131, 700, 701, neural_lm.SINGLES + neural_lm.MIDDLE + 3])
    after = {a: rng.dirichlet(np.full(len(some), 0.3)) for a in range(len(some))}
    chain = [1]
    for _ in range(6000):
        chain.append(rng.choice(len(some), p=after[chain[-1]]))
    ids = some[chain].astype(np.int32)
    model, stepper = stepped(ids, np.array([0]), 150)
    truth = np.mean([np.log(after[a][b]) for a, b in zip(chain, chain[1:], strict=False)])
    got = stepper.m.token_log_probabilities(ids, np.array([0]))[1:].mean()
    assert got > truth - 0.12 and got > model.token_log_probabilities(ids, np.array([0]))[1:].mean() + 0.2
    hidden = stepper.m.hidden(neural_lm._contexts(ids[:40], np.array([0, 7])))
    outcomes = np.exp(stepper.m.log_probabilities(hidden))
    members = np.stack([np.exp(stepper.m.member_log_probabilities(hidden, c)).sum(axis=1) for c in range(neural_lm.CLASSES)], axis=1)
    singles, classes, buckets = np.split(outcomes, [neural_lm.SINGLES, neural_lm.SINGLES + neural_lm.CLASSES], axis=1)
    assert np.allclose(singles.sum(axis=1) + (classes * members).sum(axis=1) + buckets.sum(axis=1), 1, atol=1e-4)


def test_steps_are_averaged_over_tasks(spark):
    """One task gives its own model; equal tasks give the same one."""
    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 300, 400).astype(np.int32) for _ in range(6)]
    model = neural_lm.LogBilinear.start(np.bincount(np.concatenate(texts), minlength=neural_lm.IDS))
    df = spark.createDataFrame([(t.tolist(),) for t in texts], "ids array<int>").coalesce(1)
    got = neural_lm.trained(df, model, 0)
    stepper = neural_lm.Stepper(model, 0)
    stepper.step(np.concatenate(texts), np.arange(0, 2400, 400))
    for part in neural_lm.PARTS:
        assert np.allclose(getattr(got, part), getattr(stepper.m, part), atol=1e-3), part


def test_minibatches_use_the_same_memory():
    """New pages for each minibatch's vectors took a quarter of the training's time."""
    ids = (np.random.default_rng(3).zipf(1.2, neural_lm.BATCH) % neural_lm.IDS).astype(np.int32)
    stepper = neural_lm.Stepper(neural_lm.LogBilinear.start(np.bincount(ids, minlength=neural_lm.IDS)), 1)
    starts = np.arange(0, len(ids), 500)
    stepper.step(ids, starts)
    tracemalloc.start()
    stepper.step(ids, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * ids.size * neural_lm.DIMENSIONS * 4


def test_sums_by_key_are_those_of_a_scatter():
    """Few and many rows a key, over and under a block; ``np.add.reduceat`` took most of what the products left."""
    rng = np.random.default_rng(4)
    for keys in (np.array([0]), np.array([7] * 16 + [3]), np.array([7] * 17), (rng.zipf(1.3, 5000) % neural_lm.IDS), np.zeros(700, int)):
        keys = keys.astype(np.int32)
        table = rng.normal(size=(len(keys), 5)).astype(np.float32)
        groups = neural_lm.Groups(keys)
        want = np.zeros((neural_lm.IDS, 5))
        np.add.at(want, keys, table)
        assert groups.keys.tolist() == sorted(set(keys.tolist())) and (groups.keys[groups.inverse] == keys).all()
        got = groups.sums(table, np.empty((2 * len(keys), 5), np.float32), np.empty((len(groups.keys), 5), np.float32))
        assert np.allclose(got, want[groups.keys], atol=1e-3)


def test_tokens_are_scored_as_by_whole_rows():
    """Scores of tokens equal those of all words; exponentials beyond single precision too."""
    rng = np.random.default_rng(5)
    ids = rng.integers(0, neural_lm.IDS, 1500).astype(np.int32)
    starts = np.array([0, 1, 700])
    model = stepped(ids, starts, 3)[1].m
    for shift in (0, 500, -500):
        model.b += np.float32(shift)
        model.u += np.float32(shift)
        hidden, want = model.hidden(neural_lm._contexts(ids, starts)), np.zeros(len(ids))
        outcomes = model.log_probabilities(hidden)
        for i, x in enumerate(ids.tolist()):
            want[i] = outcomes[i, neural_lm.outcome(np.array([x]))[0]]
            if 0 <= x - neural_lm.SINGLES < neural_lm.MIDDLE:
                c, member = divmod(x - neural_lm.SINGLES, neural_lm.MEMBERS)
                want[i] += model.member_log_probabilities(hidden[i : i + 1], c)[0, member]
        assert np.allclose(model.token_log_probabilities(ids, starts), want, atol=1e-3 if shift else 1e-4), shift
        assert np.allclose(model.token_log_probabilities(ids, starts, 700), want, atol=1e-3 if shift else 1e-4), shift
        model.b -= np.float32(shift)
        model.u -= np.float32(shift)


def test_words_are_cut_without_an_object_each():
    """As bytes are split; a batch's Python memory is its distinct words, not all of them."""
    some = ["", None, "  ", " A\x0bB\x0c c\r\n", "\x1ca\x85b\xa0C \u00c9", "one", "ONE one\t\ttwo ", "\n"]
    words, sizes = neural_lm.words_of(pa.array(some))
    want = [(t or "").encode().lower().split() for t in some]
    assert words.cast(pa.binary()).to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(ws) for ws in want]
    assert neural_lm.buckets(words.cast(pa.binary())[2:]).tolist() == [neural_lm.bucket(w) for ws in want for w in ws][2:]
    tracemalloc.start()
    words, sizes = neural_lm.words_of(pa.array(["word other " * 50_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes.tolist() == [100_000] and len(words.dictionary_encode().dictionary) == 2 and peak < 2_000_000


def test_tail_words_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(neural_lm.head_of, "__defaults__", (3,))
    long = "w" * 200
    df = spark.createDataFrame([(i, f"a a a b b c d {long}" if i % 2 else "a b e") for i in range(30)] + [(99, "a " * 40_000)], "doc_id long, text string")
    tokens = {r.doc_id: [*r.text.encode().split(), neural_lm.END] for r in df.collect()}
    counts = Counter(w for i, ws in tokens.items() if neural_lm.fold(i) != 2 for w in ws)
    for r in neural_lm.lm_scores(df).collect():
        want = sum(math.log10((counts[w] + 1) / (sum(counts.values()) + len(counts) + 1)) for w in tokens[r.doc_id])
        assert math.isclose(r.base_score, want, rel_tol=1e-9, abs_tol=1e-6) and r.n_known == sum(counts[w] > 0 for w in tokens[r.doc_id])


def test_urls(spark):
    urls = ["https://A.Example.ORG/es/x?q", "http://b.example.org/en/12#t", "http://org", "x://com/fr/", "http://h.com/de/", "http://h.net/x", None, "no scheme", "://y.org/?a", "http://notorg/es/", "a://b://c.org/"]
    rows = [(i, u, None) for i, u in enumerate(urls)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_graph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1] == ("b.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("org", "", None, "allow") and got[3] == ("com", "/fr/", "com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8] == ("y.org", "/", "org/", "allow") and got[9][2] is None and got[10][:2] == ("b:", "//c.org/")


def walked(edges, seeds, hosts, damping=0.85, returned=True):
    """PageRank by power iteration, the dangling mass returned to the seeds, or lost and in units of the seeds' mass."""
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b, n in edges:
        m[at[b], at[a]] += n
    out = m.sum(axis=0)
    m = m / np.where(out > 0, out, 1)
    s = np.array([seeds.get(h, 0.0) for h in hosts]) / (max(1, sum(seeds.values())) if returned else 1)
    score = s.copy()
    for _ in range(400):
        score = (1 - damping) * s + damping * (m @ score + (score[out == 0].sum() * s if returned else 0))
    return dict(zip(hosts, score, strict=True))


def test_trust_equals_power_iteration(spark):
    rnd = random.Random(9)
    pairs = sorted({(f"h{rnd.randrange(12)}", f"h{rnd.randrange(12)}") for _ in range(25)})
    edges = [(a, b, 1 + n % 3) for n, (a, b) in enumerate(pairs) if a != b]
    df = spark.createDataFrame([("w", *e) for e in edges], "walk string, src string, dst string, n long")
    got = {r.host: r.score for r in host_graph.spread(df, spark.createDataFrame([("w", "h0", 2), ("w", "h3", 1)], "walk string, host string, mass long"), tolerance=1e-6).collect()}
    want = walked(edges, {"h0": 2, "h3": 1}, [f"h{i}" for i in range(12)])
    assert all(math.isclose(got.get(h, 0.0), x, abs_tol=1e-5) for h, x in want.items())
    assert math.isclose(sum(got.values()), 1)


def test_walks_steps_are_planned_once_and_hubs_salted(spark, monkeypatch):
    """Adaptive plans of the steps took over 1500 MB of the driver's memory for the smallest pages."""
    plans, write = [], host_graph.materialise
    monkeypatch.setattr(host_graph, "materialise", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    hosts = [f"h{i}" for i in range(1201)]
    edges = [("h0", h, 1 + i % 3) for i, h in enumerate(hosts[1:])] + [(h, "h0", 1) for h in hosts[1::2]]
    for many, salted in ((edges, True), (edges[:500] + edges[1200:1300], False)):
        plans.clear()
        df = spark.createDataFrame([("w", *e) for e in many], "walk string, src string, dst string, n long")
        got = {r.host: r.score for r in host_graph.spread(df, spark.createDataFrame([("w", "h0", 2), ("w", "h3", 1)], "walk string, host string, mass long"), tolerance=1e-6).collect()}
        want = walked(many, {"h0": 2, "h3": 1}, hosts)
        assert all(math.isclose(got.get(h, 0.0), x, abs_tol=1e-5) for h, x in want.items())
        steps = [p for name, p in plans if name == "host-ranks"]
        assert steps and not any("AdaptiveSparkPlan" in p or ("BroadcastExchange" in p) != salted for p in steps)


def test_walks_steps_write_few_files(spark, monkeypatch):
    """Where a session keeps many shuffle partitions, each shuffle of a small graph left files for all of them: 211 tasks' took 0.34 GB."""
    tables, write, steady = [], host_graph.materialise, host_graph._steady

    def held(session, parts):
        out = steady(session, parts)
        out.conf.set("spark.sql.shuffle.partitions", "64")
        return out

    def kept(df, name):
        tables.append((name, df._jdf.queryExecution().executedPlan().toString(), out := write(df, name)))
        return out

    monkeypatch.setattr(host_graph, "_steady", held)
    monkeypatch.setattr(host_graph, "materialise", kept)
    edges = [(f"h{i}", f"h{i * 7 % 30}", 1) for i in range(30) if i * 7 % 30 != i]
    df = spark.createDataFrame([("w", *e) for e in edges], "walk string, src string, dst string, n long")
    got = {r.host: r.score for r in host_graph.spread(df, spark.createDataFrame([("w", "h1", 2), ("w", "h3", 1)], "walk string, host string, mass long"), tolerance=1e-6).collect()}
    want = walked(edges, {"h1": 2, "h3": 1}, [f"h{i}" for i in range(30)])
    assert all(math.isclose(got.get(h, 0.0), x, abs_tol=1e-5) for h, x in want.items())
    steps = [(plan, table) for name, plan, table in tables if name == "host-ranks"]
    # one join a step, not a second chain of steps for the one before the last; one task's files
    assert steps and all(plan.count("SortMergeJoin") == 8 and plan.count("Coalesce 1") == 9 and len(table.inputFiles()) == 1 for plan, table in steps)


def test_links_carry_distrust(spark):
    rows = [(1, "http://bad.com/de/x", ""), (2, "http://friend.net/", '<a href="//bad.com/p"> <a href="/own"> <a href="more">'), (3, "http://good.net/", "<a href='https://x.org/'>"), (4, "http://x.org/a", '<a href="http://liked.net/">'), (5, "http://liked.net/", None)]
    got = {r.page_id: r.verdict for r in host_graph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_suffixes_share_nothing(spark):
    urls = ["http://evil.co.uk/x", "http://www.evil.co.uk/", "http://bank.co.uk/", "http://a.b.site.com/de/", "http://c.site.com/y", "http://site.com/z", "http://other.com/z", "http://one.host.xy/", "http://two.host.xy/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    judged = host_graph.ruled(df, ["page_id"])
    pairs = {(r.src, r.dst) for r in host_graph.kin_edges(judged).collect()}
    assert {p for p in pairs if p[0] > p[1]} == {("www.evil.co.uk", "evil.co.uk"), ("site.com", "b.site.com"), ("b.site.com", "a.b.site.com"), ("site.com", "c.site.com"), ("one.host.xy", "host.xy"), ("two.host.xy", "host.xy")}
    assert {r.src for r in host_graph.kin_edges(judged, ("host.xy",)).collect()} == {"www.evil.co.uk", "evil.co.uk", "site.com", "b.site.com", "a.b.site.com", "c.site.com"}
    rules = (("evil.co.uk", "/x", "block"),)
    got = {r.page_id: r.verdict for r in host_graph.judge_urls(df, ["page_id"], rules).collect()}
    assert [i for i, v in got.items() if v == "block"] == [0, 1]


def test_urls_of_nothing_repeated_and_clashing(spark):
    schema = "page_id long, url string, html string, host string, score string"
    assert host_graph.judge_urls(spark.createDataFrame([], schema), ["page_id"]).count() == 0
    rows = [(1, "http://a.com/de/", "", "h", "s"), (1, "http://a.com/de/", "", "h", "s"), (None, "http://a.com/", "x" * 200_000, None, None), (2, None, None, None, None)]
    got = host_graph.judge_urls(spark.createDataFrame(rows, schema), ["page_id", "score"]).collect()
    assert sorted((r.page_id or 0, r.score, r.verdict) for r in got if r.score) == [(1, "s", "block")] * 2
    assert sorted(((r.page_id or 0, r.verdict) for r in got if not r.score)) == [(0, "block"), (2, "allow")]


def test_both_verdicts_among_reached_hosts(spark):
    """Three allowed pages far away don't outweigh, nor are outweighed by, one blocked page: each host is judged by its own neighbours."""
    url = lambda i, host, path="/": (i, f"http://{host}{path}", None)
    rows = [url(i, "far.org") for i in range(30)] + [url(100, "a.one.com", "/fr/x"), url(101, "a.one.com", "/fr/y"), url(102, "one.com"), url(103, "b.one.com", "/de/x"), url(104, "a.two.com", "/de/x"), url(105, "a.two.com", "/de/y"), url(106, "two.com"), url(107, "b.two.com", "/fr/x"), url(108, "none.net")]
    got = {r.page_id: (r.verdict, r.trust + r.distrust > 0) for r in host_graph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got[102] == ("allow", True) and got[106] == ("block", True) and got[108] == ("allow", False)


def test_op9_whole_query(spark):
    """All pages against rules and walks in plain Python."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    cut = lambda u: (low(m[1]), m[2]) if u and (m := re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)) else ("", "")
    fits, edges, want = {}, Counter(), {}
    for r in pages:
        host, path = cut(r.url)
        rules = [(len(h + p), h + p, v) for h, p, v in host_graph.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        fits[r.page_id] = (host, path, *(max(rules)[1:] if rules else (None, None)))
        for link in re.findall(r"(?i)href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)", r.html or ""):
            to = cut("x:" + link if link.startswith("//") else link)[0]
            if host and to and to != host:
                edges[host, to] += 1
    for host in {f[0] for f in fits.values()} - {""}:
        labels = host.split(".")
        suffix = 2 if len(labels) > 1 and len(labels[-1]) == 2 and labels[-2] in host_graph.SECOND else 1
        for i in range(len(labels) - suffix - 1):
            for pair in ((".".join(labels[i:]), ".".join(labels[i + 1 :])), (".".join(labels[i + 1 :]), ".".join(labels[i:]))):
                want[pair] = 1
    edges.update(want)
    hosts = sorted({x for e in edges for x in e} | {f[0] for f in fits.values()})
    seeds = {v: Counter(f[0] for f in fits.values() if f[3] == v and f[0]) for v in ("allow", "block")}
    trust = walked([(a, b, n) for (a, b), n in edges.items()], seeds["allow"], hosts, returned=False)
    distrust = walked([(b, a, n) for (a, b), n in edges.items()], seeds["block"], hosts, returned=False)
    close = 1e-3 * (seeds["allow"].total() + seeds["block"].total())
    for r in host_graph.op9_host_graph(spark, SF).collect():
        host, path, rule, verdict = fits.pop(r.page_id)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if verdict or abs(trust[host] - distrust[host]) > close or trust[host] + distrust[host] < 1e-9:
            assert r.verdict == (verdict or ("block" if distrust[host] > trust[host] else "allow")), host
    assert not fits


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, "n " * 60, None, None, None), (7, docs.where("doc_id = 7").first().text, "en", "s", 1)], DOCS)
    docs = docs.unionByName(extra)
    kept = corpus_pipeline.quality(spark, docs, SF)
    verdicts = {r.doc_id: r.kept for r in quality.judge(docs, ["doc_id"]).collect() if r.doc_id != 7}
    assert sorted(kept.columns) == sorted(docs.columns)
    assert {r.doc_id for r in kept.collect() if r.doc_id != 7} == {i for i, k in verdicts.items() if k}
    unique = corpus_pipeline.near_dedup(spark, kept, SF)
    rows = [(r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()]
    assert sorted(r.doc_id for r in unique.where("doc_id is not null").collect()) == sorted(i for i, (c, _) in grouped(rows, 5).items() if i == c)
    mixed = corpus_pipeline.mixing(spark, unique, SF)
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= {r.doc_id for r in unique.collect()} and set(times.values()) <= {1, 2}
    assert corpus_pipeline.tokens(spark, mixed, SF).count() == mixed.count()


def test_near_dedup_keeps_every_text(spark):
    """Repeated ids with different texts, copies under other ids, repeated rows, nulls and blanks."""
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "alpha beta gamma delta epsilon zeta")
    rows = [(7, a), (7, b), (8, b), (9, a), (None, c), (None, c), (10, c), (11, None), (11, None), (12, " "), (13, "x y"), (13, "x y")]
    docs = spark.createDataFrame([(i, t, "en", None, 1, "clash") for i, t in rows], f"{DOCS}, `group` string")
    for _ in range(2):
        got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
        assert got == sorted([(7, a), (7, b), (10, c), (11, None), (11, None), (12, " "), (13, "x y")], key=str)
    only_null = docs.where("doc_id is null")
    assert [tuple(r)[:2] for r in corpus_pipeline.near_dedup(spark, only_null, SF).collect()] == [(None, c)]


def test_pipeline_run_equals_brute_force(spark):
    import hashlib

    from tokenizers import Tokenizer

    from chatlake.llm.bpe import public_vocabulary
    from chatlake.llm.mixture import mix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.op7_quality(spark, SF).collect() if r.kept}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    groups = grouped([(j, x.text) for j, x in rows.items()], 5)
    unique = [r for i, r in rows.items() if groups[i][0] == i]
    keyed = spark.createDataFrame(unique, docs.schema).withColumn("_key", corpus_pipeline._content())
    copies = {r.doc_id: r.copies for r in mix(keyed, keys=("doc_id", "_key")).collect()}
    tok = Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for r in unique:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        packed = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[r.doc_id, len(ids), packed, hashlib.sha256((r.text or "").encode()).hexdigest()] += copies[r.doc_id]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_pipeline_of_nothing(spark, stage):
    assert stage(spark, spark.createDataFrame([], DOCS), SF).count() == 0


def test_small_tables_are_written_by_few_tasks(spark, monkeypatch):
    """Each shuffle of a few rows had as many tasks as the session has partitions; 211 of them filled the driver in the pipeline."""
    from chatlake.llm import components, mixture

    tasks, write = [], common.materialise

    def kept(df, name):
        tasks.append((name, df._jdf.queryExecution().toRdd().getNumPartitions()))
        return write(df, name)

    for module in (components, mixture):
        monkeypatch.setattr(module, "materialise", kept)
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        found = components.components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "u long, v long").coalesce(1))
        assert {(r.node, r.component) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
        parts = dict(tasks[1:])
        assert parts == {"edges": 1}
        bins = spark.createDataFrame([("a", n, 3) for n in range(1, 9)], "source string, size long, n long").coalesce(1)
        sources = spark.createDataFrame([("a", 108, 24, 120.0)], "source string, source_size long, docs long, target double").coalesce(1)
        tasks.clear()
        assert mixture.dual(bins, sources).count() == 1
        assert tasks and all(n <= spark.sparkContext.defaultParallelism for _, n in tasks)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
