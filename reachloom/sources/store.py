"""Stored tables that take batches of changes: each key once, merged by a rule for each column.

A store is a folder of Parquet, dealt by a hash of the key into buckets. A batch rewrites only the buckets that it touches
(dynamic partition overwrite); each row of a bucket carries the number of the last batch that the bucket took. Numbers
grow, so a batch that comes again after a failure skips the buckets that have it and does the others: whatever the order
of failures, each bucket takes each batch once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved

#: What a column's rule does with the stored and the new values of a key; `latest` goes by the store's time column.
RULES = ("sum", "min", "max", "latest")
_MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class Store:
    """A table of one row for each key. rules: column -> rule of RULES; time: the column that orders values (it is one of the
    columns, itself kept as its greatest)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], rules: dict[str, str], time: str | None = None, buckets: int = 64):
        if bad := [c for c, r in rules.items() if r not in RULES]:
            raise ValueError(f"no such rule for {bad}")
        if time is None and "latest" in rules.values():
            raise ValueError("latest needs a time column")
        self.spark, self.path, self.keys, self.rules, self.time, self.buckets = spark, path, keys, rules, time, buckets

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in _MISSING:
                raise
            return None

    def read(self) -> DataFrame | None:
        """keys, columns and time; None while nothing is stored."""
        rows = self._stored()
        return None if rows is None else rows.drop("bucket", "batch")

    def _merged(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in self.rules if c != self.time]
        latest = [c for c in columns if self.rules[c] == "latest"]
        made: list[Column] = [getattr(F, self.rules[c])(c).alias(c) for c in columns if c not in latest]
        if self.time:
            made.append(F.max(self.time).alias(self.time))
        if latest:
            # of equal times the greatest values
            made.append(F.max(F.struct(self.time, *latest)).alias("__latest"))
        out = rows.groupBy(*self.keys).agg(*made)
        return out.select(*self.keys, *[(F.col(f"__latest.{c}") if c in latest else F.col(c)).alias(c) for c in [*columns, *([self.time] if self.time else [])]])

    def upsert(self, changes: DataFrame, batch: int) -> None:
        """Merges the changes of batch number `batch` (batches come in order; one may come again)."""
        names = [*self.keys, *[c for c in self.rules if c != self.time], *([self.time] if self.time else [])]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        new = self._merged(changes.select(*names)).select("*", bucket)  # what is alike in a batch meets before anything stored
        stored = self._stored()
        if stored is not None:
            done = stored.groupBy("bucket").agg(F.max("batch").alias("__done"))  # a row for each bucket
            new = new.join(F.broadcast(done), "bucket", "left").where(F.col("__done").isNull() | (F.col("__done") < batch)).drop("__done")
            touched = saved(new, "changes")
            old = stored.join(F.broadcast(touched.select("bucket").distinct()), "bucket", "left_semi")
            new = self._merged(touched.select(*names).unionByName(old.select(*names))).select("*", bucket)
        whole = saved(new.withColumn("batch", F.lit(batch).cast("bigint")), "merged")  # the store is read until here
        whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


def lead_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """Leads by url: first and last time seen, everything else as it was last."""
    rules = {"first_seen": "min", "name": "latest", "designation": "latest", "company": "latest"}
    return Store(spark, path, ["url"], rules, "last_seen", buckets)


def metric_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """A10: metrics of a job: `added` adds up, `value` is as it was set last."""
    return Store(spark, path, ["job", "name"], {"added": "sum", "value": "latest"}, "at", buckets)


def evidence_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """The latest evidence of a job, kind and key, and when it expires (null: never)."""
    return Store(spark, path, ["job", "kind", "key"], {"evidence": "latest", "expires": "latest"}, "created", buckets)


def valid_evidence(store: Store, now: Column) -> DataFrame:
    """What hasn't expired at a time."""
    return store.read().where(F.col("expires").isNull() | (F.col("expires") > now))
