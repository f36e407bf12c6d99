"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Of all mixes that meet the sources' word targets, entropy balancing takes the one whose document
rates stay closest to 1 in relative (Fermi-Dirac) entropy with rates from 0 to ``cap``. Its convex
dual has one variable a source; at the optimum a document of x words has the exponentially tilted
rate ``cap * e / (e + cap - 1)`` with ``e = exp(lambda * x / mean)``, which is 1 at lambda = 0 and
stays within the cap. Newton steps on the dual need two sums a source and step, taken over the
distinct sizes of each source; a bracket guards every step. Rates become whole copies size by size,
in a cumulative rounding that keeps each source's error within its longest text, and a few repair
rounds then move single copies, and exchange copies of near sizes, to close what is left. Copies go to the documents of one size by
their id's hash, ranked within salted parts so that no size is ever sorted in one task.

Documents meet only in sums by (source, size[, salt]) and in one join back to those sums. Nothing is
random; reruns agree.

Defined cases: null text has size 0; the null source is a source and comes last; sources whose
texts hold no words have target 0; documents of size 0 are taken once and count nothing; equal
documents and repeated ids are told apart only by rank; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import gathered, materialise, n_words, read

#: Weights by the sources' rank, repeating.
WEIGHTS = (3, 1, 2)
SALTS = 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size -> adds target.

    Sources in code-point order (null last) get the weights in turn and share ``share`` of all
    words. A target stops at ``cap`` times its source's size; the excess goes to the others by
    weight, which ends where every open target is weight * level: sources fill up in the order of
    size over weight, so running sums give the level. One row a source, so one task.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.col("source_size") * cap).withColumn("fill", F.col("limit") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    open_ = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("full", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    )
    # the first source (in filling order) that the level doesn't fill sets the level
    stays = F.col("fill") >= F.col("level")
    level = open_.withColumn("level", F.min_by(F.when(stays, F.col("level")), F.when(stays, F.col("fill"))).over(everything))
    return level.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))).alias("target"))


def _rate(tilt: Column, x: Column, cap: float) -> Column:
    e = F.exp(F.least(F.greatest(tilt * x, F.lit(-500.0)), F.lit(500.0)))
    return cap * e / (e + (cap - 1))


def dual(bins: DataFrame, sources: DataFrame, cap: float = 2.0, rounds: int = 8, steps: int = 4, tolerance: float = 1e-9) -> DataFrame:
    """Newton's method on every source's dual at once: source, scale, tilt (per scaled word).

    ``bins``: source, size, n. A step that leaves the bracket of signs seen so far bisects it. After
    each round of steps the state is written, and one number (the worst relative gap) comes back.
    """
    state = sources.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap)).select(
        "source", "target", (F.col("source_size") / F.col("docs")).alias("scale"), F.lit(0.0).alias("tilt"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"), F.lit(1.0).alias("gap")
    )
    for _ in range(rounds):
        for _ in range(steps):
            state = _step(bins, state, cap)
        state = materialise(gathered(state), "mix-tilts")
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    # sums of floating-point numbers differ in their last digits from run to run; the tilt doesn't
    return state.select("source", "scale", F.round("tilt", 9).alias("tilt"))


def _step(bins: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    key = ["source", "target", "scale", "tilt", "low", "high"]
    x = F.col("size") / F.col("scale")
    rate = _rate(F.col("tilt"), x, cap)
    sums = (
        bins.alias("b")
        .join(state.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        .select("s.source", *key[1:], (F.col("n") * rate * F.col("size")).alias("words"), (F.col("n") * rate * (1 - rate / cap) * F.col("size") * x).alias("curve"))
        .groupBy(*key)
        .agg(F.sum("words").alias("words"), F.sum("curve").alias("curve"))
    )
    sums = gathered(sums)
    miss = F.col("words") - F.col("target")
    newton = F.col("tilt") - F.try_divide(miss, F.col("curve"))
    high, low = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high")), F.when(miss > 0, F.col("low")).otherwise(F.col("tilt"))
    bounded = sums.select("source", "target", "scale", newton.alias("newton"), low.alias("low"), high.alias("high"), F.abs(miss / F.col("target")).alias("gap"))
    inside = (F.col("newton") >= F.col("low")) & (F.col("newton") <= F.col("high"))
    return bounded.select("source", "target", "scale", F.when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"), "low", "high", "gap")


def copies_by_size(bins: DataFrame, sources: DataFrame, tilts: DataFrame, cap: int = 2, repairs: int = 12) -> DataFrame:
    """source, size, n -> adds rate and copies (of all n documents together)."""
    s, t = sources.alias("s"), tilts.alias("t")
    rated = (
        bins.alias("b")
        .join(s, F.col("b.source").eqNullSafe(F.col("s.source")))
        .join(t, F.col("b.source").eqNullSafe(F.col("t.source")), "left")
        .select("b.source", "b.size", "b.n", "s.target", F.when(F.col("t.tilt").isNotNull(), _rate(F.col("t.tilt"), F.col("b.size") / F.col("t.scale"), float(cap))).when(F.col("s.target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0)).alias("rate"))
        .withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(F.col("rate")))
    )
    running = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = F.floor(F.sum(F.col("rate") * F.col("n")).over(running) + 0.5)
    previous = F.coalesce(F.lag("total").over(Window.partitionBy("source").orderBy(F.col("size").desc())), F.lit(0))
    rounded = rated.withColumn("total", total).withColumn("copies", F.col("total") - previous).drop("total")
    state = rounded.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), F.col("n") * cap)).cast("bigint"))
    own = Window.partitionBy("source")
    for _ in range(repairs):
        gap = F.round(F.col("target") - F.sum(F.col("copies") * F.col("size")).over(own)).cast("bigint")
        room = F.when(F.col("gap") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        moves = F.least(room, F.floor(F.abs("gap") / F.greatest(F.col("size"), F.lit(1))).cast("bigint")) * (F.col("size") > 0).cast("int")
        best = F.max(F.when(F.col("moves") > 0, F.col("size"))).over(own)
        state = (
            state.withColumn("gap", gap)
            .withColumn("moves", moves)
            .withColumn("best", best)
            .withColumn("copies", F.col("copies") + F.when(F.col("size") == F.col("best"), F.col("moves") * F.signum(F.col("gap").cast("double")).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
            .drop("gap", "moves", "best")
        )
    return _swapped(state, cap).drop("place")


def _swapped(state: DataFrame, cap: int, swaps: int = 6, reach: int = 8) -> DataFrame:
    """Closes what single copies can't: one copy of a size for one of a near smaller size, or back.

    Each round takes every source's widest exchange between sizes at most ``reach`` places apart
    that doesn't pass its target.
    """
    own, order = Window.partitionBy("source"), Window.partitionBy("source").orderBy("size")
    state = state.withColumn("place", F.row_number().over(order))
    for _ in range(swaps):
        state = state.withColumn("gap", F.round(F.col("target") - F.sum(F.col("copies") * F.col("size")).over(own)).cast("bigint"))
        up = F.col("gap") > 0
        gives, takes = F.col("copies") > 0, F.col("n") * cap > F.col("copies")
        state = state.withColumn("larger", F.when(up, takes).otherwise(gives)).withColumn("smaller", F.when(up, gives).otherwise(takes) & (F.col("size") > 0))
        steps = []
        for k in range(1, reach + 1):
            step = F.col("size") - F.lag("size", k).over(order)
            steps.append(F.when(F.col("larger") & F.lag("smaller", k).over(order) & (step <= F.abs("gap")), F.struct(step.alias("step"), F.col("place").alias("at"), F.lit(k).alias("k"))))
        state = state.withColumn("exchange", F.array_max(F.array(*steps))).withColumn("exchange", F.max("exchange").over(own))
        sign = F.when(up, 1).otherwise(-1)
        moved = F.when(F.col("place") == F.col("exchange.at"), sign).when(F.col("place") == F.col("exchange.at") - F.col("exchange.k"), -sign).otherwise(0)
        state = state.withColumn("copies", F.col("copies") + F.coalesce(moved, F.lit(0))).drop("gap", "larger", "smaller", "exchange")
    return state


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys, source, text -> the keys, source, size, source_size, target, source_gap, rate, copies.

    ``source_gap``: the words by which the source's copies miss its target, 0 or near it wherever the
    sizes allow.
    """
    sized = materialise(
        docs.select(*keys, "source", n_words(F.col("text")).alias("size")).withColumn("order", F.xxhash64(*keys, "size")).withColumn("salt", F.pmod(F.col("order"), F.lit(SALTS))), "sizes"
    )
    parts = materialise(sized.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "size-parts")
    bins = materialise(gathered(parts.groupBy("source", "size").agg(F.sum("n").alias("n"))), "size-bins")
    per_source = gathered(bins.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")))
    goals = targets(per_source.select("source", "source_size"), weights, share, float(cap)).alias("g")
    sources = materialise(gathered(per_source.alias("p").join(goals, F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.source", "p.source_size", "docs", "target")), "mix-sources")
    planned = materialise(gathered(copies_by_size(bins, sources, dual(bins, sources, float(cap)), cap)), "mix-copies")
    # what neither steps nor repairs closed is told with every row
    gaps = planned.groupBy("source").agg((F.sum(F.col("copies") * F.col("size")) - F.max("target")).alias("source_gap")).alias("g")
    sources = materialise(gathered(sources.alias("p").join(gaps, F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.*", "source_gap")), "mix-gaps")
    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source", "size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).alias("o")
    plan = planned.alias("c")
    plan = materialise(
        offsets.join(plan, F.col("o.source").eqNullSafe(F.col("c.source")) & (F.col("o.size") == F.col("c.size")))
        .join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")))
        .select("o.source", "o.size", "salt", "offset", "rate", F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("more"), "s.source_size", "s.target", "s.source_gap"),
        "mix-plan",
    ).alias("m")
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("order", *keys))).alias("d")
    return ranked.join(plan, F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col("d.size") == F.col("m.size")) & (F.col("d.salt") == F.col("m.salt"))).select(
        *(f"d.{k}" for k in keys), "d.source", "d.size", "source_size", "target", "source_gap", "rate", (F.col("each") + (F.col("rank") + F.col("offset") <= F.col("more")).cast("int")).cast("bigint").alias("copies")
    )


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source_gap")
