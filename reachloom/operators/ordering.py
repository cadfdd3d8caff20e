"""Ranks and orders over whole tables without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved

_LOW = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its place in an order, from 1. The order has to be total.

    Rows are dealt by ranges of the order and sorted within them; a range's rows are counted, and the sum of the ranges
    before it (a row for each range) is added to the places within.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = saved(dealt, "ordered").withColumn("__range", F.shiftright("__at", 33))
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("__range").alias("__r"), before.alias("__before"))
    placed = dealt.join(F.broadcast(starts), F.col("__range") == F.col("__r"))  # a row for each partition
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit(_LOW)) + 1).drop("__at", "__range", "__r", "__before")


def first_rows(df: DataFrame, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of an order with their places: each task keeps n, and n rows are numbered."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def interleaved(df: DataFrame, stage: Column, weights: dict[int, int], order: list[Column], name: str = "place") -> DataFrame:
    """Rows of several stages taken by turns: in each round a stage gives as many rows as its weight, in its own
    order. Stages are whole numbers, which also give the order within a round."""
    rows = df.withColumn("__stage", stage)
    own = numbered(rows, [F.col("__stage"), *order], "__n")
    firsts = saved(own, "staged")
    starts = firsts.groupBy(F.col("__stage").alias("__s")).agg(F.min("__n").alias("__first"))  # a row for each stage
    within = firsts.join(F.broadcast(starts), F.col("__stage") == F.col("__s")).withColumn("__k", F.col("__n") - F.col("__first"))
    size = F.lit(1)
    for s, w in weights.items():
        size = F.when(F.col("__stage") == s, F.lit(w)).otherwise(size)
    turn = within.withColumn("__round", F.floor(F.col("__k") / size))
    return numbered(turn, [F.col("__round"), F.col("__stage"), F.col("__k")], name).drop("__stage", "__n", "__s", "__first", "__k", "__round")


def combinations(dimensions: list[DataFrame], name: str = "place") -> DataFrame:
    """All combinations of the rows of k tables, numbered from 1 so that the first ones touch every row: the diagonals
    through the longest table, then by the sum of the places, the greatest place and the places in order.

    A combination is a number: its digits, one for each table with the table's size as base, are the places. So the
    combinations come from a range, meet their rows by equi-joins, and are numbered by ranges of the order. Columns are the
    tables' own (their names have to differ); the tables' order is that of all their columns.
    """
    spark = dimensions[0].sparkSession
    placed = [saved(numbered(d, [F.col(c) for c in d.columns], f"__p{k}").withColumn(f"__p{k}", F.col(f"__p{k}") - 1), "dimension") for k, d in enumerate(dimensions)]
    sizes = [p.count() for p in placed]
    total = 1
    for n in sizes:
        total *= n
    places, base = [], total
    for n in sizes:
        base //= max(n, 1)
        places.append(F.pmod(F.floor(F.col("id") / F.lit(base)) if base > 1 else F.col("id"), F.lit(n)).cast("bigint"))
    rows = spark.range(total).select(*[p.alias(f"__p{k}") for k, p in enumerate(places)])
    own = [F.col(f"__p{k}") for k in range(len(sizes))]
    longest = own[sizes.index(max(sizes))]
    diagonal = F.lit(True)
    for p, n in zip(own, sizes, strict=True):
        diagonal = diagonal & (p == longest % n)
    first = F.when(diagonal, 0).otherwise(1)
    some = F.when(diagonal, longest).otherwise(sum(own[1:], own[0]))
    top = F.when(diagonal, 0).otherwise(F.greatest(*own) if len(own) > 1 else own[0])
    out = numbered(rows.select("*", first.alias("__d"), some.alias("__s"), top.alias("__m")), [F.col(c) for c in ("__d", "__s", "__m")] + own, name)
    for k, p in enumerate(placed):
        out = out.join(p, f"__p{k}")
    return out.select(*[c for d in dimensions for c in d.columns], name)
