"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where it names none, a local session gets a folder of its own; a
    cluster without one is an error, as executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='reachloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def trim_driver(spark: SparkSession) -> str | None:
    """Has the driver's JVM give memory that its native allocator holds but doesn't use back to the system: what the C++
    side (compilers, many short-lived threads of broadcasts) has freed stays with the process otherwise. What the JVM says
    of it; None where it can't (the command is HotSpot's on Linux)."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = jvm.java.lang.Class.forName(kind)
    given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    given[1] = "systemTrimNativeHeap"
    call = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
    try:
        return str(call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given))
    except Py4JJavaError:
        return None


class Scratch:
    """The tables that saved() writes while it is entered. delete() is for callers that have written out all that was
    made from them; tables of others stay."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._open.remove(self)

    def delete(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths.clear()


#: Shuffle files of a statement go when it has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, by: str | None = None, buckets: int = 1) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and outlives executors. What the write has
    shuffled is dropped at once: nothing reads it again. With `by` it is a bucketed table: joins on that column with
    tables of as many buckets need no shuffle."""
    spark = df.sparkSession
    key = f"{name}-{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{key}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        if by:
            key = key.replace("-", "_")
            df.write.bucketBy(buckets, by).option("path", path).format("parquet").saveAsTable(key)
        else:
            df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    if Scratch._open:
        Scratch._open[-1].paths.append(path)
    return spark.table(key) if by else spark.read.schema(df.schema).parquet(path)


#: Tables of as many rows at most are sent whole to each executor for a join.
FEW_ROWS = 100_000


def by_size(df: DataFrame) -> DataFrame:
    """A saved table, for a join with rows that come from exploding: sent whole if it has few rows, else shuffled. Spark
    takes exploded rows for as small as the file that they come from, and would send those whole by way of the driver."""
    return df.hint("broadcast" if df.count() <= FEW_ROWS else "merge")
