"""Fill-in-the-middle, ranked lexical search and token counts against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.llm import fill_middle as M
from chatlake.llm import lexical_search as L
from chatlake.llm.bpe import public_vocabulary
from chatlake.llm.registry import ORACLE_SQL, QUERIES
from chatlake.llm.token_counts import ChunkedEncoder, op13_token_counts, token_counts
from tests.conftest import SF

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "the", " the", "é", "中", "ɷ", "▁", "\0", "<P>", "<", "=", "0", "ing", "　", "\x1c"]


def _texts(n: int, longest: int, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    return ["", " ", "x", *("".join(r.choice(PIECES) for _ in range(r.randrange(1, longest))) for _ in range(n))]


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_lexical_search"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE_SQL[name])
    ours = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    at = [list(rel.columns).index(c) for c in sorted(df.columns)]
    assert ours == sorted(repr([r[i] for i in at]) for r in rel.fetchall())


# fill-in-the-middle


def _plainly(text: str, doc_id) -> tuple:
    units = UNITS.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h4 % 100 < 80 else (n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def test_every_cut_of_a_text_by_any_block_size():
    for text in _texts(40, 60):
        units = UNITS.findall(text)
        for block in (1, 2, 7, 64):
            own = M.Units(text.encode(), block)
            assert own.n == len(units)
            for k in range(len(units) + 1):
                before = "".join(units[:k])
                assert own.cut(k) == (len(before.encode()), len(before))


def test_fenwick_sums_after_updates():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (37, 2))
    tree = M.Fenwick(counts)
    for i in (0, 5, 36, 5):
        tree.add(i, (2, 3))
        counts[i] += (2, 3)
    sums = np.concatenate([np.zeros((1, 2), int), np.cumsum(counts, axis=0)])
    for k in range(1, int(counts[:, 0].sum()) + 1):
        i, before = tree.descend(k)
        assert sums[i, 0] < k <= sums[i + 1, 0] and before.tolist() == sums[i].tolist()


def test_fill_middle_equals_plain_python_and_restores(spark):
    rows = [(i, t) for i, t in enumerate(_texts(200, 80))] + [(5, None), (None, "a b c"), (None, "a b c"), (7, " ".join(map(str, range(30_000))))]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, form string, ______ int")
    made = M.fill_middle(docs)
    got = [(r["doc_id"], r["text"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) for r in made.collect()]
    assert Counter(got) == Counter((i, t, *_plainly(t or "", i)) for i, t in rows)
    assert {f for _, _, _, f, *_ in got} == {"plain", "psm", "spm"} and "______" in made.columns
    assert M.restore(made).where("restored <> coalesce(text, '')").count() == 0
    assert M.fill_middle(docs.limit(0)).count() == 0


def test_other_marks_and_rates_restore_and_ambiguous_marks_are_refused(spark):
    own = M.Settings(7, 100, 50, "[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame(list(enumerate(_texts(60, 40))), "doc_id long, text string")
    made = M.fill_middle(docs, own)
    assert M.restore(made, own).where("restored <> text").count() == 0 and made.where("form = 'plain'").count() == docs.where("text = ''").count()
    with pytest.raises(ValueError):
        M.fill_middle(docs, M.Settings(prefix="aa", suffix="ab", middle="c"))


# search


def _found(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    terms = [re.findall("[^\\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    n_docs, total = sum(1 for t in terms if t), sum(map(len, terms))
    df = Counter(x for t in terms for x in set(t))
    out = []
    for item, text in items:
        own = re.findall("[^\\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        scored = []
        for (doc, _), t in zip(docs, terms, strict=True):
            tf = Counter(t)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * (25 + 75 * len(t) * n_docs // total))) for x in own if tf[x])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


CORPUS = [(1, "Red fox, red hen"), (2, "red fox"), (3, "the FOX. the hen; the É"), (4, None), (5, ""), (6, " -- "), (7, "red fox"), (7, "red fox"), (None, "fox é"), (8, "foxes reds xred"), (9, "hen " * 3000 + "fox")]
ITEMS = [(1, "red fox fox"), (2, "É hen"), (3, None), (4, "?!"), (5, "nothing here"), (1, "the reds"), (None, "xred 7")]


@pytest.mark.parametrize("k,group_bytes", [(10, 1 << 20), (2, 1 << 20), (3, 4)])
def test_search_equals_a_scan_of_all_documents(spark, k, group_bytes):
    docs = spark.createDataFrame([(i, t, 0) for i, t in CORPUS], "doc_id long, text string, score int").repartition(3)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, rank string")
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in L.search(docs, items, k, group_bytes).collect()]
    assert Counter(got) == Counter(_found(CORPUS, ITEMS, k))


def test_search_ties_go_to_the_smallest_ids_across_tasks(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("red fox").alias("text")).unionByName(spark.createDataFrame([(9999, "hen " * 9000)] * 5000, "doc_id long, text string")).repartition(7)
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert [(r["rank"], r["doc_id"]) for r in L.search(docs, items).orderBy("rank").collect()] == [(i + 1, i) for i in range(10)]


def test_search_of_nothing_and_items_beyond_the_bound(spark):
    docs, items = spark.createDataFrame(CORPUS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert L.search(docs.limit(0), items).count() == 0 and L.search(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.search(docs, items, most_bytes=5)


def test_best_keeps_the_best_of_many_small_additions():
    rng = np.random.default_rng(5)
    scores, ids = rng.integers(0, 50, (5000, 3)), rng.permutation(5000)
    best = L.Best(3, 4)
    best.most = 40
    for at in range(0, 5000, 100):
        best.add(scores[at : at + 100], ids[at : at + 100], np.zeros(100, np.int64))
    rows = best.cut()
    for i in range(3):
        own = sorted((-s, d) for s, d in zip(scores[:, i].tolist(), ids.tolist(), strict=True) if s > 0)[:4]
        assert [(-s, d) for s, d in zip(rows[1, rows[0] == i].tolist(), rows[2, rows[0] == i].tolist(), strict=True)] == own


# token counts


def test_spliced_chunks_have_the_whole_text_s_ids():
    encoder = ChunkedEncoder(public_vocabulary("piece_bpe_32k.model"), 48, 8)
    long = ["a" * 700, " " * 700, "=-" * 400, "é中" * 300, "the " * 300, "ɷ" * 300, "a" * 300 + " b" + "c" * 300, "<s>" * 200, "x" * 100 + "▁" * 300]
    for text in _texts(400, 300) + long:
        assert [x for s in encoder.spans(text) for x in s] == encoder.model.encode(text)
    assert encoder.widened > 0


def test_token_counts_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, " x"), (3, "word " * 5000), (4, "é"), (5, "<s> </s>")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, n_tokens string")
    model = ChunkedEncoder(public_vocabulary("piece_bpe_32k.model")).model
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, public_vocabulary("piece_bpe_32k.model")).collect())
    assert got == Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in rows)
    assert token_counts(docs.limit(0), public_vocabulary("piece_bpe_32k.model")).count() == 0


def test_op13_equals_the_library(spark):
    model = ChunkedEncoder(public_vocabulary("piece_bpe_32k.model")).model
    want = {r["doc_id"]: len(model.encode(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in op13_token_counts(spark, SF).collect()} == want
