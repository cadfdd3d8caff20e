"""Contact files, sheets as folders, and fixed column orders for exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column order of each export.
EXPORT_COLUMNS = {
    "leads": ["Name", "Designation", "Company", "Location", "LinkedIn ID", "LinkedIn URL", "Source", "Confidence", "Evidence"],
    "rejections": ["Name", "Designation", "Company", "LinkedIn URL", "Reason", "Source", "Evidence"],
    "company_pocs": ["Name", "Designation", "Company", "LinkedIn ID", "LinkedIn URL", "Source", "Confidence", "Match Evidence", "Requested Company",
                     "Requested Designation"],
    "company_poc_review": ["Name", "Designation", "Company", "LinkedIn URL", "Source", "Evidence", "Requested Company", "Requested Designation", "Reason"],
    "speakers": ["Name", "Designation", "Company", "Country", "LinkedIn ID", "LinkedIn URL", "Match Status", "Confidence", "Match Evidence", "Source URL"],
    "competitor_leads": ["Name", "COMPANY", "DESIGNATION", "PHONE NUMBER", "LinkedIn Id", "Competitor Source", "Event Signal", "Event Probability",
                         "Signal Confidence", "Signal Evidence", "Location Verified", "What Company Does", "Net Profit", "Matched Parameters"],
}
ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")
#: windows-1252 is ISO-8859-1 with other characters for these bytes; Spark reads the latter.
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
UNDEFINED = "\x81\x8d\x8f\x90\x9d"
WINDOWS = "".join(c if c in UNDEFINED else c.encode("latin-1").decode("cp1252") for c in CONTROLS)


def _line(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).where("trim(value) != ''").limit(1).collect()
    return first[0]["value"] if first else ""


def detect_encoding(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The first encoding that can read every line; the last one stands if none can."""
    bad = {"UTF-8": ("UTF-8", "\ufffd"), "windows-1252": ("ISO-8859-1", f"[{UNDEFINED}]"), "ISO-8859-1": ("ISO-8859-1", "(?!)")}
    for encoding in encodings[:-1]:
        charset, pattern = bad[encoding]
        lines = spark.read.option("encoding", charset).option("sep", "\x01").option("quote", "").csv(path)
        if lines.where(F.concat_ws("", *lines.columns).rlike(pattern)).isEmpty():
            return encoding
    return encodings[-1]


def read_contacts_csv(
    spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS, delimiter: str | None = None
) -> DataFrame:
    """All columns as strings; rows without any value are dropped. The encoding is the first that reads the whole
    file; the delimiter is the one the header line has most of, unless given. A byte order mark isn't part of a name."""
    if not path.lower().rstrip("/").endswith((".csv", ".tsv", ".txt")):
        raise ValueError(f"not a delimited text file: {path}")
    encoding = detect_encoding(spark, path, encodings)
    if delimiter is None:
        header = _line(spark, path)
        delimiter = max(",;\t|", key=header.count)
    charset = "UTF-8" if encoding == "UTF-8" else "ISO-8859-1"
    df = spark.read.option("header", True).option("encoding", charset).option("sep", delimiter).option("multiLine", True).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns]).dropna("all")
    if encoding == "windows-1252":
        named = str.maketrans(CONTROLS, WINDOWS)
        df = df.select(*[F.translate(F.col(f"`{c}`"), CONTROLS, WINDOWS).alias(c.translate(named)) for c in df.columns])
    return df


def read_sheets(spark: SparkSession, sheets: dict[str, str]) -> DataFrame:
    """Several files as one table with the column `sheet`; columns that a sheet lacks are null."""
    parts = [read_contacts_csv(spark, path).withColumn("sheet", F.lit(name)) for name, path in sheets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in their fixed order; missing ones stay empty."""
    have = set(df.columns)
    chosen = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns]
    df.select(*chosen).write.option("header", True).mode("overwrite").csv(path)


def write_sheets(frames: dict[str, DataFrame], root: str) -> None:
    """One folder for each sheet."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    """S11."""
    df.write.mode("overwrite").json(path)


MESSAGE_EVENTS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("campaign_id", T.StringType()), T.StructField("recipient_id", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("occurred_at", T.TimestampType()), T.StructField("provider_event_id", T.StringType()),
])
