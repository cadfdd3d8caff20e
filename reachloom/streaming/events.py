"""Message events as Structured Streaming jobs; plans/table_queries.py has their batch twins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.campaigns import recipient_state  # noqa: F401  (R02 runs on streams as well: all its parts combine)
from ..sources.files import MESSAGE_EVENTS
from ..sources.store import Store


def read_events(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(MESSAGE_EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def distinct_events(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each provider event once, however often it is delivered within the lateness."""
    return events.withWatermark("occurred_at", lateness).dropDuplicatesWithinWatermark(["provider_event_id"])


class LiveFunnel:
    """A06's cumulative stages of each campaign, kept current as events come, in any order.

    A recipient's state is counts and maxima (R02), which a batch's events are merged into; a row also keeps the status that
    it had before the batch that changed it last. The rows of a batch, now and when it comes again, so say which counts by
    status fall and rise. Both tables take each batch once (sources/store.py).
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        states = {"opens": "sum", "clicks": "sum", "final": "max", "before": "latest"}
        self.states = Store(spark, f"{folder}/states", ["campaign_id", "recipient_id"], states, "changed", buckets)
        self.counts = Store(spark, f"{folder}/counts", ["campaign_id", "status"], {"n": "sum"}, None, buckets)

    @staticmethod
    def status() -> Column:
        final = F.col("final.event_type")
        return F.when(final.isNotNull(), final).when(F.col("clicks") > 0, "CLICKED").when(F.col("opens") > 0, "OPENED").otherwise("SENT")

    def apply(self, events: DataFrame, batch: int) -> None:
        """Takes the events (id, campaign_id, recipient_id, event_type, occurred_at) of a batch."""
        told = F.when(F.col("event_type").isin("REPLIED", "BOUNCED", "UNSUBSCRIBED"), F.struct("occurred_at", "id", "event_type"))
        count = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
        new = events.groupBy("campaign_id", "recipient_id").agg(count("OPENED").alias("opens"), count("CLICKED").alias("clicks"), F.max(told).alias("final"))
        old = self.states.read()
        if old is None:
            new = new.withColumn("before", F.lit(None).cast("string"))
        else:
            new = new.join(old.select("campaign_id", "recipient_id", self.status().alias("before")), ["campaign_id", "recipient_id"], "left")
        self.states.upsert(new.withColumn("changed", F.lit(batch).cast("bigint")), batch)
        rows = self.states.read().where(F.col("changed") == batch).withColumn("now", self.status())
        moves = F.explode(F.array(F.struct(F.col("before").alias("status"), F.lit(-1).alias("n")), F.struct(F.col("now").alias("status"), F.lit(1).alias("n"))))
        deltas = rows.where("before IS NULL OR before != now").select("campaign_id", moves.alias("m")).select("campaign_id", "m.*").where("status IS NOT NULL")
        self.counts.upsert(deltas.groupBy("campaign_id", "status").agg(F.sum("n").alias("n")), batch)

    def read(self) -> DataFrame:
        """campaign_id, total, sent, opened, clicked, replied, bounced, unsubscribed."""
        n = lambda *kinds: F.coalesce(F.sum(F.when(F.col("status").isin(*kinds), F.col("n"))), F.lit(0))
        return self.counts.read().groupBy("campaign_id").agg(
            F.sum("n").alias("total"), n("SENT", "OPENED", "CLICKED", "REPLIED").alias("sent"), n("OPENED", "CLICKED", "REPLIED").alias("opened"),
            n("CLICKED").alias("clicked"), n("REPLIED").alias("replied"), n("BOUNCED").alias("bounced"), n("UNSUBSCRIBED").alias("unsubscribed"))

    def follow(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes a stream of events; a restart goes on where it stopped."""
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def suppress(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Recipients that bounced or unsubscribed, once each, with the time of their first such event in the batch that
    brought it. Each batch writes a folder of its own number, so that a batch that is run again after a failure replaces
    what it wrote; what earlier batches wrote is left out. The checkpoint makes a restart go on where it stopped (R04)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col("event_type").isin("BOUNCED", "UNSUBSCRIBED")).groupBy("recipient_id").agg(F.min("occurred_at").alias("since"))
        try:
            known = spark.read.parquet(folder).where(F.col("batch") < number).select("recipient_id")
            new = new.join(known, "recipient_id", "left_anti")
        except AnalysisException as e:  # nothing is there yet
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        new.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
