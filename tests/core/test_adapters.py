"""Adapters and reviews leave nothing out."""

from pyspark.sql import functions as F

from reachloom.plans import adapters, identity_queries
from reachloom.session import table


def test_whole_texts(spark, small):
    rows = adapters.frame(spark, small, "search_rows").join(table(spark, small, "documents").withColumnRenamed("doc_id", "seq"), "seq")
    assert rows.count() == table(spark, small, "documents").count()
    assert rows.where(F.length("text") > 600).count() > 0 and rows.where("NOT body <=> text").count() == 0


def test_all_orders(spark, small):
    orders = table(spark, small, "orders")
    history = adapters.frame(spark, small, "history_contacts")
    assert orders.where("o_custkey % 2 = 1").count() > 0 and history.count() == orders.count()


def test_reviews_reach_every_record(spark):
    seen = identity_queries._overrides(spark.range(1, 37).withColumnRenamed("id", "seq"))
    assert seen.count() == 36
