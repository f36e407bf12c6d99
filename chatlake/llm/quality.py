"""Quality rules: robust multivariate outliers by minimum covariance determinant, natively.

Every document becomes a vector of transformed statistics. Per language and source, concentration
steps look for the ``H`` of documents whose covariance has the least determinant: each step takes the
documents nearest by Mahalanobis distance and computes the centre and covariance of those, until
no determinant falls any more. There are two starts, medians with median deviations and plain means
with covariances; the smaller determinant counts. Documents far from that estimate are rejected.
A source with fewer than ``LEAST`` documents of a language is judged by the estimate over all
documents of its language; languages with fewer than ``LEAST`` in all are judged together by one
estimate over their documents, however few. Only documents that pass the base rules count.

Only column expressions and grouped sums are used. The texts are read once, to make one short row a
document; steps aggregate those rows map-side, so a hot source costs no more than its share.
Features sit on a grid of 0.001 and distances on a logarithmic one, which bounds the exact
percentiles' buffers and makes reruns agree.

Defined cases: null text has no words (and fails the base rules); null languages and sources are
groups of their own; equal and repeated rows are all counted; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import SPACES, gathered, let, materialise, read, words

SYMBOLS = "[#*$%&|<>]"
#: Share of a group that the estimate rests on, and the documents that a source or language needs for its own.
H, LEAST = 0.75, 40
#: Steps stop once no logarithm of a determinant falls by more than the one; so many suffice by far.
SETTLED, STEPS = 1e-4, 60
#: Share of normal vectors that would be taken for outliers.
TAIL = 4e-8
#: Smallest standard deviation of each feature, so that a constant one doesn't reject its first exception.
FLOORS = (0.08, 0.15, 0.5, 0.5)
FEATURES = ("x0", "x1", "x2", "x3")
P = len(FEATURES)


def _beyond(x: float, degrees: int) -> float:
    """The chi-squared tail beyond x, for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def _quantile(tail: float, degrees: int) -> float:
    low, high = 0.0, 2000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _beyond(middle, degrees) > tail else (low, middle)
    return low


def cutoff_of(tail: float = TAIL, h: float = H) -> float:
    """The squared distance that a share ``tail`` of normal vectors exceeds.

    The covariance of the nearest ``h`` of normal vectors is too small by a known factor, which
    widens the distances; the cut-off is widened by the same.
    """
    return _quantile(tail, P) * h / (1 - _beyond(_quantile(1 - h, P), P + 2))


def _repeated(w: Column) -> Column:
    """Words in windows of three that occur twice or more: the union of those windows' positions."""
    n = F.size(w)

    def positions(found: Column) -> Column:
        gaps = F.transform(found, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(found, j + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def ordered(s: Column) -> Column:
        same = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), positions)

    def hashed(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), ordered))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 4, F.lit(0)).otherwise(let(windows, hashed)).cast("bigint")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def statistics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select(
        *keys,
        let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeated(w).alias("n_repeat_words"))).alias("_counted"),
        F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.when(F.contains(text, F.lit("\n")), _dup_lines(text)).otherwise(F.lit(0)).cast("bigint").alias("n_dup_lines"),
    )
    out = counted.select(*keys, F.col("_counted.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_counted.n_repeat_words").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = [F.log(1 + F.col("word_chars") / n), F.log(1 + 100 * F.col("n_symbols") / n), F.log(1 + 200 * F.col("n_dup_lines") / n), F.log(1 + 10 * F.col("n_repeat_words") / n)]
    return [F.round(x, 3).alias(name) for x, name in zip(raw, FEATURES, strict=True)]


def _grouped(stats: DataFrame) -> DataFrame:
    """Adds the vector, the group that judges it, and the groups whose estimates it takes part in.

    A group is (level, language, source): level 0 a source within its language, 1 a language, 2 all
    languages that are too small for 1.
    """
    sizes = gathered(stats.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n")))
    languages = gathered(sizes.groupBy("lang").agg(F.sum("n").alias("n"), F.min("n").alias("least")))
    a, b = sizes.alias("a"), languages.alias("b")
    sizes = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang"))).select("a.lang", "a.source", F.when(F.col("a.n") >= LEAST, 0).when(F.col("b.n") >= LEAST, 1).otherwise(2).alias("level"), (F.col("least") < LEAST).alias("asked"))
    v, s = stats.select("*", *_vector()).alias("v"), sizes.alias("s")
    joined = v.join(s, F.col("v.lang").eqNullSafe(F.col("s.lang")) & F.col("v.source").eqNullSafe(F.col("s.source")), "left")

    def group(level: Column) -> Column:
        return F.struct(level.alias("level"), F.when(level < 2, F.col("v.lang")).alias("lang"), F.when(level < 1, F.col("v.source")).alias("source"))

    # all rows of a source without a passing document fail the base rules anyway
    own = group(F.coalesce(F.col("s.level"), F.lit(2)))
    return joined.select("v.*", own.alias("grp"), F.when((F.col("s.level") == 0) & F.col("s.asked"), F.array(own, group(F.lit(1)))).otherwise(F.array(own)).alias("grps"))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor l of the estimate."""
    y: list[Column] = []
    for i in range(P):
        r = F.col(FEATURES[i]) - F.col(f"m{i}")
        for j in range(i):
            r = r - F.col(f"l{i}{j}") * y[j]
        y.append(r / F.col(f"l{i}{i}"))
    out = y[0] * y[0]
    for v in y[1:]:
        out = out + v * v
    return out


def _cholesky(cov: DataFrame) -> DataFrame:
    """grp, n, m*, c* -> grp, n, m*, l*: one column at a time, with floors on the diagonal."""
    out = cov
    for i in range(P):
        out = out.withColumn(f"c{i}{i}", F.col(f"c{i}{i}") + FLOORS[i] ** 2)
    for j in range(P):
        for i in range(j, P):
            r = F.col(f"c{i}{j}")
            for k in range(j):
                r = r - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(r, F.lit(1e-9))) if i == j else r / F.col(f"l{j}{j}"))
    return out.select("grp", "n", *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in _pairs()))


def _measured(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    return rows.alias("r").join(estimate.alias("e"), F.col("r.grp").eqNullSafe(F.col("e.grp")), "left").select("r.*", "e.n", _distance().alias("d2"))


def _estimate(rows: DataFrame) -> DataFrame:
    """Centre and covariance of each group's rows."""
    sums = rows.groupBy("grp").agg(F.count("*").alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(FEATURES)), *(F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}{j}") for i, j in _pairs()))
    return _cholesky(gathered(sums).select("grp", "n", *(f"m{i}" for i in range(P)), *((F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i, j in _pairs())))


def _log_determinant() -> Column:
    out = F.log(F.col("l00"))
    for i in range(1, P):
        out = out + F.log(F.col(f"l{i}{i}"))
    return 2 * out


def mcd(rows: DataFrame, h: float = H, steps: int = STEPS, settled: float = SETTLED) -> DataFrame:
    """grp, x* -> grp, n (the whole group's), m*, l*: the estimate of each group."""
    medians = rows.groupBy("grp").agg(F.count("*").alias("n"), *(F.percentile(x, F.lit(0.5)).alias(f"m{i}") for i, x in enumerate(FEATURES)))
    centred = rows.alias("r").join(gathered(medians).alias("e"), F.col("r.grp").eqNullSafe(F.col("e.grp"))).select("r.grp", "e.n", *(f"m{i}" for i in range(P)), *(F.round(F.abs(F.col(x) - F.col(f"m{i}")), 3).alias(x) for i, x in enumerate(FEATURES)))
    spread = centred.groupBy("grp", "n", *(f"m{i}" for i in range(P))).agg(*(((1.4826 * F.percentile(x, F.lit(0.5))) ** 2).alias(f"c{i}{i}") for i, x in enumerate(FEATURES)))
    start = _cholesky(gathered(spread).select("*", *(F.lit(0.0).alias(f"c{i}{j}") for i, j in _pairs() if i != j)))
    # each start is a group of its own
    named = lambda df, i: df.withColumn("grp", F.struct(F.lit(i).alias("start"), F.col("grp").alias("of")))
    plain = _estimate(rows)
    estimate = materialise(gathered(named(start, 0).unionByName(named(plain, 1)).withColumn("log_det", F.lit(float("inf")))), "mcd-estimate")
    totals = estimate.where("grp.start = 0").select(F.col("grp.of").alias("grp"), F.col("n").alias("all"))
    twice = rows.withColumn("grp", F.explode(F.array(*(F.struct(F.lit(i).alias("start"), F.col("grp").alias("of")) for i in range(2)))))
    for _ in range(steps):
        measured = _measured(twice, estimate.drop("log_det")).withColumn("ring", F.floor(F.log(F.col("d2") + 1e-6) * 200))
        bound = measured.groupBy("grp").agg(F.percentile("ring", F.lit(h)).alias("bound"))
        near = measured.alias("a").join(gathered(bound).alias("b"), F.col("a.grp").eqNullSafe(F.col("b.grp"))).where(F.col("ring") <= F.col("bound")).select("a.grp", *FEATURES)
        before, after = estimate.alias("a"), _estimate(near).withColumn("log_det", _log_determinant()).alias("b")
        # a step that doesn't lessen the determinant is not taken
        better = F.col("b.log_det") < F.col("a.log_det") - settled
        chosen = before.join(after, F.col("a.grp").eqNullSafe(F.col("b.grp"))).select("a.grp", better.alias("better"), *(F.when(better, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in estimate.columns if c != "grp"))
        stepped = materialise(gathered(chosen), "mcd-estimate")
        estimate = stepped.drop("better")
        if stepped.where("better").isEmpty():
            break
    else:
        raise RuntimeError(f"the estimates didn't settle in {steps} steps")
    best = estimate.groupBy("grp.of").agg(F.min_by(F.struct(*(c for c in estimate.columns if c != "grp")), F.struct("log_det", "grp.start")).alias("best")).select(F.col("of").alias("grp"), "best.*")
    best = gathered(best)
    return best.alias("e").join(totals.alias("t"), F.col("e.grp").eqNullSafe(F.col("t.grp"))).select("e.grp", F.col("all").alias("n"), *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in _pairs()))


def judge(docs: DataFrame, keys: list[str], cutoff: float | None = None) -> DataFrame:
    """The key columns and statistics of every document, d2 (squared distance) and kept.

    ``cutoff``: the largest squared distance that is kept; by default that of ``cutoff_of()``.
    """
    stats = materialise(statistics(docs, list(dict.fromkeys([*keys, "lang", "source"]))), "statistics")
    rows = materialise(_grouped(stats), "vectors")
    estimate = mcd(rows.where(~F.col("base_failed")).select(F.explode("grps").alias("grp"), *FEATURES))
    measured = _measured(rows.drop("grps"), estimate)
    return measured.withColumn("kept", ~F.col("base_failed") & ~(F.coalesce(F.col("d2"), F.lit(0.0)) > (cutoff_of() if cutoff is None else cutoff)))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"]).select("doc_id", *COLUMNS, "kept")
