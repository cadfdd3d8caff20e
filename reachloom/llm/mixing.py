"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source gets a target in words: weights share out a budget, no source goes over max_copies times its own words,
and what capped sources leave is shared among the others by weight. A source's target is then met with whole copies
of every document as far as they fit, and with a sample for the rest: each document has an inclusion probability
proportional to the root of its size, so that the expected words are the rest. Documents whose probability would reach
one are certain: they are taken out first, the largest before others, and the odds of the others are set for what is
left. Each of the others gets the rank

    random odds / inclusion odds

and is taken in the order of ranks until the source's words are used up. The random number comes from a hash of the
document's id and a seed, so that reruns agree.

Cases: a null or empty text has size 0 and is never taken. A null source is a source of its own, the last. Repeated
rows are documents of their own. Equal ranks go by id, then by the row. An empty table gives an empty result.
Other columns are carried along by `mix`'s caller through `carry`; result names win over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .quality import words_of

#: Steps of the coarse order; only the step that holds a source's limit is sorted row by row.
STEPS = 4096


def source_targets(
    sizes: DataFrame, weights: list[float], budget: float = 1.5, max_copies: int = 2
) -> DataFrame:
    """One row for each source: source_size, weight, target.

    weights are dealt to the sources in code-point order (null last), again and again. The capped sources are those
    whose limit for a unit of weight is lowest: the level is the first at which the sources not yet capped take
    what is left without reaching their own limits.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(dealt, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    per = per.withColumn("__cap", F.col("source_size") * F.lit(float(max_copies)))
    by = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    per = (
        per.withColumn("__left", F.sum("source_size").over(all_rows) * F.lit(float(budget))
                       - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("__level", F.col("__left") / F.col("__open"))
        .withColumn("__fits", F.col("__level") * F.col("weight") <= F.col("__cap"))
        .withColumn("__first", F.min(F.when(F.col("__fits"), F.struct(F.row_number().over(by), "__level"))).over(all_rows))
    )
    level = F.col("__first.__level")
    target = F.when(level.isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), level * F.col("weight")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a key's hash."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def inclusion(rows: DataFrame) -> DataFrame:
    """__t (source), __certain (the size from which documents are certain), __odds: the others are included with a
    probability of __odds times the root of their size.

    rows: source, rest, size, of the documents that can be taken. Works on the number of documents of each size, of
    which a source has no more than its longest document has words. Going down from the largest, a size is certain as
    long as its probability would reach one among the documents not yet certain; the first that doesn't ends it.
    """
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    sizes = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"))
    size, n = F.col("size").cast("double"), F.col("n")
    larger = lambda c: F.sum(c).over(down) - c
    every = Window.partitionBy("source")
    left = F.col("rest") - larger(size * n)
    roots = F.sum(n * F.pow(size, 1.5)).over(every) - larger(n * F.pow(size, 1.5))
    steps = sizes.select("source", "size", (left / F.greatest(roots, F.lit(1e-300))).alias("odds"))
    # All documents of a size are certain together: taking one leaves no lower odds for the next.
    ends = steps.where(F.col("odds") * F.sqrt(F.col("size").cast("double")) < 1)
    first = ends.groupBy("source").agg(F.max(F.struct("size", "odds")).alias("x"))
    return rows.select("source").distinct().join(
        first.select(F.col("source").alias("__f"), "x"), F.col("source").eqNullSafe(F.col("__f")), "left"
    ).select(
        F.col("source").alias("__t"), F.coalesce(F.col("x.size") + 1, F.lit(0)).alias("__certain"),
        F.coalesce(F.col("x.odds"), F.lit(0.0)).alias("__odds"),
    )


def _cut(rows: DataFrame, can: Column, id_column: str) -> DataFrame:
    """rows with __extra 1 for those among `can` that come before the first that goes over the source's rest."""
    steps = rows.where(can).groupBy("source", "__step").agg(
        F.sum("size").alias("__words"), F.first("rest").alias("rest"))
    along = Window.partitionBy("source").orderBy("__step")
    cuts = (
        steps.withColumn("__upto", F.sum("__words").over(along))
        .where(F.col("__upto") > F.col("rest") + 1e-6)
        .groupBy(F.col("source").alias("__s"))
        .agg(F.min(F.struct("__step", F.expr("__upto - __words AS before"))).alias("__cut"))
    )
    placed = rows.join(cuts, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    inside = Window.partitionBy("source").orderBy("__rank", id_column, "__row")
    at_cut = placed.where(can & (F.col("__step") == F.col("__cut.__step")))
    upto = F.col("__cut.before") + F.sum("size").over(inside)
    at_cut = at_cut.select(F.col("__row").alias("__r"), (upto <= F.col("rest") + 1e-6).alias("__in"))
    placed = placed.join(at_cut, F.col("__row") == F.col("__r"), "left").drop("__r")
    chosen = can & (F.col("__cut").isNull() | (F.col("__step") < F.col("__cut.__step")) | F.coalesce("__in", F.lit(False)))
    return placed.withColumn("__extra", F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(F.col("__extra"))).drop("__in", "__cut")


def mix(
    docs: DataFrame,
    weights: list[float],
    budget: float = 1.5,
    max_copies: int = 2,
    seed: int = 1,
    id_column: str = "doc_id",
    source: str = "source",
    text: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """Rows of docs with source, size, source_size, target, copies and taken = copies * size.

    Documents larger than what the sample may take have no chance in it. After the sample is cut before the document
    that would go over the target, the remaining documents no larger than the gap are taken by rank as far as they fit,
    again and again until none fits.
    """
    extra = [c for c in carry or [] if c not in (id_column, "source", "size", "source_size", "target", "copies", "taken")]
    rows = saved(
        docs.select(
            F.col(id_column).alias(id_column),
            F.col(source).cast("string").alias("source"),
            F.size(words_of(F.col(text).cast("string"))).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("__row"),
            *[F.col(c) for c in extra],
        ),
        "sizes",
    )
    sizes = rows.drop(*extra)  # only the last step reads the carried columns
    per = source_targets(sizes, weights, budget, max_copies)
    per = (
        per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
        .select(F.col("source").alias("__s"), "source_size", "target", "whole", "rest")
    )
    per = saved(per, "targets")
    small = F.col("size") <= F.col("rest") + 1e-6
    joined = sizes.join(per, F.col("source").eqNullSafe(F.col("__s")))
    per = per.join(inclusion(joined.where(small & (F.col("size") > 0))), F.col("__s").eqNullSafe(F.col("__t")), "left").drop("__t")
    per = saved(per, "odds")  # a row for each source: the plans below use it many times
    ranked = sizes.join(per, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    u = uniform(F.col(id_column), seed)
    certain = small & (F.col("size") >= F.col("__certain"))
    chance = F.least(F.lit(1 - 1e-12), F.col("__odds") * F.sqrt(F.col("size").cast("double")))
    rank = F.when(certain, F.lit(0.0)).when(
        small & (F.col("size") > 0) & (chance > 0), (u / (1 - u)) / (chance / (1 - chance)))
    ranked = ranked.withColumn("__rank", rank)
    step = F.floor(F.lit(STEPS) * F.col("__rank") / (1 + F.col("__rank")))
    ranked = ranked.withColumn("__step", F.when(certain, F.lit(-1)).otherwise(step)).drop("__certain", "__odds")
    can = (F.col("size") > 0) & F.col("__rank").isNotNull()
    taken = saved(_cut(ranked.withColumn("__extra", F.lit(0)), can, id_column), "sample")
    limits = per.select(F.col("__s").alias("__g"), F.col("rest").alias("__limit"))
    while True:
        sums = taken.groupBy(F.col("source").alias("__s")).agg(F.sum(F.col("__extra") * F.col("size")).alias("__had"))
        gaps = sums.join(limits, F.col("__s").eqNullSafe(F.col("__g"))).select("__s", (F.col("__limit") - F.col("__had")).alias("__gap"))
        gaps = saved(gaps, "gaps")  # a row for each source
        now = taken.drop("rest").join(gaps, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumnRenamed("__gap", "rest")
        fits = can & (F.col("__extra") == 0) & (F.col("size") <= F.col("rest") + 1e-6)
        if now.where(fits).isEmpty():
            break
        taken = saved(_cut(now, fits, id_column), "fill")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("__extra")).otherwise(F.lit(0)).cast("long")
    mixed = taken.select(
        "__row", id_column, "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )
    if extra:
        mixed = mixed.join(rows.select("__row", *extra), "__row")
    return mixed.drop("__row")
