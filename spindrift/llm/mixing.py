"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Document rates r minimise the sum of r log r - r subject to one token constraint a source, sum of r * size = target,
and to r <= `most`. The solution tilts exponentially in the size, r = min(most, exp(lambda * size / mean size)), with one
multiplier lambda a source that maximises the convex dual. Newton steps, kept inside a shrinking bracket, find all
multipliers at once: each is one aggregation over the (source, size) classes, the only things the dual depends on.
Rates become whole copies class by class, so the documents are read and counted once and ranked once.

All sums are over integers or decimals, so neither partitioning nor a rerun changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import forget, shuffle_partitions, word_count, written

#: Weights that sources take in turn, by code point of their name, null last.
WEIGHTS = (5, 2, 1)
#: Documents of a class that are ranked in one window; larger classes are ranked in slices.
SLICE = 1_000
#: Rows of a table of one row a source up to which it is broadcast.
BROADCAST = 10_000


def _placed(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, weight): sources in order take the weights in turn.

    Sources are dealt in ranges of their order and numbered inside each; over the ranges themselves, one row each, run
    the numbers that they begin with.
    """
    last = F.col("source").isNull()
    n = shuffle_partitions(sources.sparkSession)
    dealt = written(sources.select("source", "source_size", last.alias("_last")).repartitionByRange(n, "_last", "source").withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    begins = counts.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    own = Window.partitionBy("_part").orderBy("_last", "source")
    at = F.col("_begin") + F.row_number().over(own) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int"))
    return dealt.join(F.broadcast(begins), "_part").select("source", "source_size", w.cast("long").alias("weight"))


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Targets are in proportion to the weights, together `share` of all sizes; one stops at `most` times its source's
    size and the excess goes to the others by weight until none is above. The rows are one a source.
    """
    rows = written(_placed(sources, weights), "weights")
    total = rows.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0]
    goal = float(total or 0) * share
    unit, capped = None, -1
    while True:  # a source that is above its limit once stays there, so this ends
        full = F.lit(False) if unit is None else F.lit(unit) * F.col("weight") > F.lit(most) * F.col("source_size")
        got = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("source_size")).otherwise(0).cast("decimal(38,0)")).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")).first()
        if got.n is None or got.n == capped or not got.open:
            break
        capped, unit = got.n, (goal - most * float(got.held or 0)) / got.open
    if unit is None:
        unit = 0.0
    aim = F.least(F.lit(float(unit)) * F.col("weight"), F.lit(float(most)) * F.col("source_size"))
    return rows.select("source", "source_size", F.when(F.lit(got.open == 0), F.lit(float(most)) * F.col("source_size")).otherwise(aim).alias("target"))


def _rate(lam: Column, size: Column, mean: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(lam * size / mean))


def solve(classes: DataFrame, targets: DataFrame, most: float = 2.0, tolerance: float = 1e-7, rounds: int = 60) -> DataFrame:
    """targets with columns lam and mean: the multiplier of each source with a positive size.

    classes: (source, size, n) with size > 0. A step that leaves the bracket of its source is replaced by halving it,
    so every multiplier converges; rounds end when no source misses its target by more than `tolerance` of it.
    """
    ratio = F.col("target") / F.col("source_size")
    counts = classes.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("docs"))
    start = (
        targets.where("source_size > 0")
        .join(counts, F.col("source").eqNullSafe(F.col("_s")))
        .select("source", "source_size", "target", (F.col("source_size") / F.col("docs")).alias("mean"))
        .select("*", F.least(F.lit(0.0), F.col("mean") * F.log(F.greatest(ratio, F.lit(1e-12)))).alias("lo"), F.when(ratio > 1, F.col("mean") * F.log(F.lit(float(most)))).otherwise(0.0).alias("hi"))
        .withColumn("lam", F.lit(0.0))
    )
    now = written(start, "lambda")
    for _ in range(rounds):
        r = _rate(F.col("lam"), F.col("size"), F.col("mean"), most)
        mass = F.col("n") * F.col("size") * r
        exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
        sums = (
            classes.join(now.select(F.col("source").alias("_s"), "lam", "mean"), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("_s")
            .agg(exact(mass).alias("got"), exact(F.when(r < most, mass * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > lo) & (step < hi)
        done = F.abs(gap) <= F.col("target") * tolerance
        stepped = now.join(sums, F.col("source").eqNullSafe(F.col("_s"))).select("source", "source_size", "target", "mean", lo.alias("lo"), hi.alias("hi"), F.when(done, F.col("lam")).when(inside, step).otherwise((lo + hi) / 2).alias("lam"), done.alias("done"))
        new = written(stepped, "lambda")
        left = new.where("not done").isEmpty()
        forget(now)
        now = new.drop("done")
        now._spindrift_path = new._spindrift_path
        if left:
            break
    return now


def _whole(classes: DataFrame, solved: DataFrame, most: float) -> DataFrame:
    """(source, size, n, k): the whole number of copies that a class of n documents of one size gets.

    Running down the sizes of a source, a class gets the difference of the rounded running sums of expected copies.
    What is then missing is made up for in rounds with the sizes that fit into it.
    """
    r = _rate(F.col("lam"), F.col("size"), F.col("mean"), most)
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum((F.col("n") * r).cast("decimal(38,9)")).over(down)
    joined = classes.join(solved.select(F.col("source").alias("_s"), "lam", "mean", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    before = F.floor(F.col("upto") - (F.col("n") * r).cast("decimal(38,9)") + F.lit(0.5).cast("decimal(2,1)"))
    top = F.lit(int(most)) * F.col("n")
    rows = joined.withColumn("upto", upto).select("source", "size", "n", "target", F.greatest(F.lit(0), F.least(top, (F.floor(F.col("upto") + F.lit(0.5).cast("decimal(2,1)")) - before).cast("long"))).alias("k"))
    now = written(rows, "copies")
    own = Window.partitionBy("source")
    gap, k = F.col("gap"), F.col("k")
    for _ in range(6):
        room = F.when(gap > 0, top - k).otherwise(k)
        fits = (room > 0) & (F.col("size") / 2 < F.abs(gap))
        by = F.least(room, F.greatest(F.lit(1).cast("long"), F.floor(F.abs(gap) / F.col("size")).cast("long")))
        change = F.when(F.col("size") == F.col("chosen"), F.when(gap > 0, by).otherwise(-by)).otherwise(F.lit(0).cast("long"))
        missed = now.withColumn("gap", F.col("target") - F.sum(k * F.col("size")).over(own))
        chosen = missed.withColumn("chosen", F.max(F.when(fits, F.col("size"))).over(own))
        new = written(chosen.select("source", "size", "n", "target", (k + change).alias("k"), (change != 0).alias("moved")), "copies")
        still = not new.where("moved").isEmpty()
        forget(now)
        now = new.drop("moved")
        now._spindrift_path = new._spindrift_path
        if not still:
            break
    return now


def plan(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """Targets (source, source_size, target) and copies (doc_id, source, size, copies) of (doc_id, source, size).

    One row of copies for each different (doc_id, source, size): rows that repeat it all get its copies. Within a
    class, documents are ranked by a hash of doc_id; the first get one copy more than the others.
    """
    keys = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    classes = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    targets = written(source_targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, most, weights), "targets")
    real = classes.where("size > 0")
    whole = _whole(real, solve(real, targets, most), most)
    placed = (
        keys.join(whole.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "k"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
        .drop("_s", "_z")
        .withColumn("h", F.xxhash64("doc_id", F.lit("mix")))
        .withColumn("slice", F.expr(f"pmod(shiftright(h, 8), ceil(coalesce(n, {1024 * SLICE}) / {SLICE}))"))
    )
    inside = Window.partitionBy("source", "size", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("at", F.coalesce(F.sum("times").over(inside), F.lit(0)))
    # Only a class of several slices has places to add: those of its slices before.
    sliced = placed.where(F.col("n") > SLICE).groupBy("source", "size", "slice").agg(F.sum("times").alias("docs"))
    earlier = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("slice").alias("_p"), F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("offset"))
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("slice") == F.col("_p")), "left")
    extra = F.col("k") % F.col("n") - F.col("at") - F.coalesce("offset", F.lit(0))
    more = (F.greatest(F.lit(0), F.least(extra, F.col("times"))) * 2 >= F.col("times")).cast("long")
    copies = F.coalesce(F.expr("k div n") + more, F.lit(1)).cast("long")
    return targets, ranked.select("doc_id", "source", "size", copies.alias("copies"))


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of documents (doc_id, text, source).

    A null or wordless text has size 0 and takes no words. A null source is a source of its own. Rows that repeat
    doc_id, source and size get the same number of copies each. An empty table gives an empty result.
    """
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "sizes")
    targets, copies = plan(sized)
    rows = sized.select("doc_id", "source", "size")
    keyed = copies.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "copies")
    t = F.broadcast(targets) if targets.count() <= BROADCAST else targets
    return (
        rows.join(keyed, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
        .join(t.select(F.col("source").alias("_t"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_t")))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it: up to two equal rows, none where it is left out.

    Documents without words stay as they are.
    """
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "sizes")
    _, copies = plan(sized)
    keyed = copies.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "copies")
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("source").alias("_src"), word_count(F.col("text")).alias("_size"))
    joined = own.join(keyed, F.col("_id").eqNullSafe(F.col("_d")) & F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))
    return joined.where("copies > 0").select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_n")).select("_row.*")
