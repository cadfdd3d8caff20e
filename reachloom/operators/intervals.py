"""Containment in document order: elements as intervals, joined on equal keys.

An element is the interval from its number to its last descendant's (both in document order). An interval is a union of
a few aligned blocks (at most two of each size 2**level); a number lies in exactly one block of each size. So the numbers
inside an interval are found by an equi-join on (page, level, block), and each pair comes once, however deep elements nest:
no pair that doesn't hold is ever made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of an outer element and an inner one that lies in it (not itself): outer (its number) and the inner columns.
    outer: page_id, node, last, levels; inner: page_id, node and whatever else."""
    # numbers from node + 1 to last, as blocks: at each level the odd ends of what is left
    low = lambda k: F.ceil((F.col("node") + 1) / F.expr("1L << k").cast("double"))
    levels = outer.where("last > node").select("page_id", F.col("node").alias("outer"), "node", "last", "levels", F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("k"))
    ends = levels.select("page_id", "outer", "levels", "k", low("k").cast("bigint").alias("a"), F.expr("(last + 1L) >> k").alias("b")).where("a < b")
    blocks = ends.select("page_id", "outer", "levels", "k", F.explode(F.filter(F.array(
        F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1)), lambda x: x.isNotNull())).alias("block"))
    high = outer.groupBy("page_id").agg(F.max("levels").alias("top"))
    inner = inner.drop("levels")
    places = inner.join(high, "page_id").select(*inner.columns, F.explode(F.sequence(F.lit(0), F.col("top"))).alias("k"))
    places = places.withColumn("block", F.expr("CAST(node AS BIGINT) >> k"))
    return blocks.join(places, ["page_id", "k", "block"]).select("page_id", "outer", *[c for c in inner.columns if c != "page_id"], "levels")


#: Text in these isn't shown.
HIDDEN = ("script", "style", "template")


def text_within(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """page_id, node, text: all shown text pieces in an element, in document order, parted by spaces. wanted: page_id, node."""
    outer = nodes.join(wanted, ["page_id", "node"], "left_semi")
    pieces = nodes.where((F.col("tag") == "#text") & ~F.col("inside").isin(*HIDDEN)).select("page_id", "node", "text")
    found = within(outer.select("page_id", "node", "last", "levels"), pieces)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x.text), " ")
    return found.groupBy("page_id", "outer").agg(joined.alias("text")).withColumnRenamed("outer", "node")
