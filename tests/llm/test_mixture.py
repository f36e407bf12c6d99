import math
import re

from pyspark.sql import functions as F

from chatlake.llm import mixture
from tests.conftest import SF


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Deals by weight, then deals the excess of full sources again, as long as there is any."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total, extra = sum(w[s] for s in open_), 0.0
        for s in list(open_):
            got[s] += left * w[s] / total
            if got[s] > cap * sizes[s]:
                extra += got[s] - cap * sizes[s]
                got[s] = cap * sizes[s]
                open_.discard(s)
        left = extra
    return got


def check(rows, sizes_of):
    sizes, taken, longest = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        longest[r.source] = max(longest.get(r.source, 0), r.size)
        assert 0 <= r.copies <= 2
        assert r.size == sizes_of[r.doc_id]
    want = brute_targets(sizes)
    for r in rows:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6) and r.source_size == sizes[r.source]
    return {s: (taken[s], want[s], longest[s]) for s in sizes}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes_of = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    mixed = mixture.mix(docs)
    rows = mixed.collect()
    assert len(rows) == docs.count()
    for taken, want, longest in check(rows, sizes_of).values():
        assert abs(taken - want) <= max(0.03 * want, 10)
    # tilted by size alone, in one direction within a source
    for s in {r.source for r in rows}:
        rates = [r.rate for r in sorted((r for r in rows if r.source == s), key=lambda r: r.size)]
        assert rates in (sorted(rates), sorted(rates, reverse=True))
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixture.mix(docs.repartition(7)).collect()))


def test_dual_meets_the_target(spark):
    bins = spark.createDataFrame([("a", 10, 5), ("a", 300, 2), ("a", 20_000, 1), ("b", 7, 9)], "source string, size long, n long")
    sources = spark.createDataFrame([("a", 20_650, 8, 4000.0), ("b", 63, 9, 126.0)], "source string, source_size long, docs long, target double")
    t = mixture.dual(bins, sources).collect()
    assert [r.source for r in t] == ["a"]
    rate = lambda x: 2 * math.exp(t[0].tilt * x / t[0].scale) / (math.exp(t[0].tilt * x / t[0].scale) + 1)
    assert math.isclose(5 * rate(10) * 10 + 2 * rate(300) * 300 + rate(20_000) * 20_000, 4000, rel_tol=1e-6)


def test_hot_source_nulls_and_ties(spark):
    rows = [(i, f"s{i % 5}" if i % 3 else None, "w " * (i % 40)) for i in range(600)] + [(1000 + i, "hot", "same words here") for i in range(400)] + [(5000, "empty", None), (5001, "empty", " \t"), (7, "s2", "again a")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("rank", F.lit(0))
    out = mixture.mix(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for i, _, t in rows:
        sizes.setdefault(i, set()).add(len((t or "").split()))
    per = {}
    for r in out:
        assert r.size in sizes[r.doc_id] and 0 <= r.copies <= 2
        per.setdefault(r.source, [0, r.target])[0] += r.size * r.copies
    for taken, want in per.values():
        assert abs(taken - want) <= 3
    assert {r.copies for r in out if r.source == "empty"} == {1}
    assert mixture.mix(df.limit(0)).count() == 0


def test_op8_whole_query(spark):
    """Every document once; taken in whole copies, at most two; each source within its reported gap of its target."""
    from chatlake.llm.mixture import op8_mixture
    from tests.conftest import SF

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_mixture(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by_source: dict = {}
    for r in rows:
        size = len(docs[r.doc_id].text.encode().split())
        assert r.size == size and r.taken in (0, size, 2 * size)
        by_source.setdefault(docs[r.doc_id].source, []).append(r)
    for own in by_source.values():
        assert {r.source_size for r in own} == {sum(r.size for r in own)} and len({(r.target, r.source_gap) for r in own}) == 1
        assert abs(sum(r.taken for r in own) - own[0].target - own[0].source_gap) < 1e-6 and abs(own[0].source_gap) <= max(1, min(r.size for r in own if r.size))
    again = {r.doc_id: r.taken for r in op8_mixture(spark, SF).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
