"""Schemas: headers of uploaded files mapped to known fields, projections of results, catalogues, fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_identity_text, text_of

# Fixed values of the data rules: the headers that each field goes by.
ALIASES = {
    "full_name": ("name", "full name", "poc", "poc name", "contact", "contact name", "contact person", "person", "lead name",
                  "prospect", "attendee", "delegate", "speaker"),
    "first_name": ("first name", "given name", "forename"),
    "last_name": ("last name", "surname", "family name"),
    "company": ("company", "organization", "organisation", "employer", "account", "firm"),
    "designation": ("designation", "title", "job title", "role", "position"),
    "email": ("email", "email address", "work email", "business email", "e mail"),
    "phone": ("phone", "phone number", "mobile", "mobile number", "contact number", "telephone", "whatsapp"),
    "linkedin_url": ("linkedin", "linkedin url", "linkedin profile", "profile url", "person linkedin"),
    "status": ("status", "outreach status", "poc status", "contact status", "response status"),
    "response": ("response", "poc response", "reply", "outcome", "feedback"),
    "notes": ("notes", "comments", "remarks", "description"),
    "owner": ("owner", "contacted by", "sdr", "bdr", "colleague", "relationship owner"),
    "contact_date": ("contact date", "outreach date", "last contacted", "date", "last activity"),
}

# The columns of the stored tables.
TABLES = {
    "campaigns": "id string, name string, status string, source_reference string, subject_template string, html_template string, "
                 "text_template string, sender_name string, reply_to string, organization_name string, organization_address string, "
                 "created_at timestamp",
    "recipients": "id string, campaign_id string, email string, full_name string, first_name string, company string, designation string, "
                  "profile_url string, source_record_id string, source_data map<string,string>, status string, response_classification string, "
                  "open_count bigint, first_opened_at timestamp, last_opened_at timestamp, click_count bigint, first_clicked_at timestamp, "
                  "last_clicked_at timestamp, replied_at timestamp, bounced_at timestamp, unsubscribed_at timestamp, leased_until timestamp, "
                  "scheduled_at timestamp, created_at timestamp",
    "message_events": "id string, campaign_id string, recipient_id string, event_type string, occurred_at timestamp, "
                      "provider_event_id string, metadata map<string,string>",
    "suppression": "email string, reason string, source string, created_at timestamp",
    "links": "token string, recipient_id string, destination_url string",
    "leads": "url string, name string, designation string, company string, location string, source string, confidence int, evidence string, "
             "first_seen timestamp, last_seen timestamp",
    "job_leads": "job_id string, url string, rank int, score int",
    "exclusion_keys": "import_id string, kind string, value string",
    "evidence": "key string, evidence string, created_at timestamp, expires_at timestamp",
    "run_metrics": "run_id string, name string, value bigint",
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """A stored table without rows."""
    return spark.createDataFrame([], TABLES[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """Df in a stored table's columns and types; missing columns are null, others are left out. An extra column
    that the table doesn't know isn't an error, a value that can't be cast is."""
    schema = empty_table(df.sparkSession, name).schema
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def detect_columns(headers: DataFrame) -> DataFrame:
    """C01 for any number of files: headers (file, column) to file, field, column (where exactly one header goes by the
    field's names) and ambiguous (where several do)."""
    spark = headers.sparkSession
    rows = [(f, a) for f, names in ALIASES.items() for a in names]
    known = spark.createDataFrame(rows, "field string, alias string")
    made = headers.select("file", "column", normalize_identity_text(F.col("column")).alias("alias"))
    hits = made.join(F.broadcast(known), "alias").groupBy("file", "field").agg(F.array_sort(F.collect_set("column")).alias("c"))  # a file's headers
    one = F.size("c") == 1
    return hits.select("file", "field", F.when(one, F.col("c")[0]).otherwise("").alias("column"), F.when(one, F.array().cast("array<string>")).otherwise(F.col("c")).alias("ambiguous"))


def validate_mapping(mapping: DataFrame, headers: DataFrame) -> DataFrame:
    """C02 for any number of files: mapping (file, field, column) against headers (file, column): one row for each file
    with its errors (array, in order; empty if it's fine)."""
    there = headers.select("file", "column", F.lit(True).alias("there")).distinct()
    rows = mapping.where(F.trim(text_of(F.col("column"))) != "").join(there, ["file", "column"], "left")
    uses = rows.groupBy("file", "column").agg(
        F.count(F.lit(1)).alias("n"), F.max("there").alias("there"),
        F.max(F.when(F.col("there") & F.col("field").isin("full_name", "first_name", "last_name"), 1)).alias("named"))
    per = uses.groupBy("file").agg(
        F.max("named").alias("named"), F.array_sort(F.collect_set(F.when(F.col("n") > 1, F.col("column")))).alias("twice"),
        F.array_sort(F.collect_set(F.when(F.col("there").isNull(), F.col("column")))).alias("missing"))
    every = headers.select("file").union(mapping.select("file")).distinct().join(per, "file", "left")
    said = lambda c, t: F.when(F.size(c) > 0, F.concat(F.lit(t), F.array_join(c, ", ")))
    return every.select("file", F.array_compact(F.array(
        F.when(F.col("named").isNull(), "Map Full name or at least one First/Last name column."),
        said("twice", "A source column cannot map to multiple fields: "),
        said("missing", "Mapped columns are missing from the selected sheet: "))).alias("errors"))


def reconcile_schema(df: DataFrame, targets: list[str]) -> DataFrame:
    """Each target column from the first column whose lower name without spaces and underscores holds the
    target's; targets without one are empty."""
    bare = lambda c: c.lower().replace(" ", "").replace("_", "")
    source = {t: next((c for c in df.columns if bare(t) in bare(c)), None) for t in targets}
    return df.select(*[(F.col(f"`{c}`").cast("string") if c else F.lit("")).alias(t) for t, c in source.items()])


def select_visible(df: DataFrame, order: list[str], chosen: list[str], default: int = 4) -> DataFrame:
    """The chosen columns in canonical order; without any the first `default`."""
    return df.select(*([c for c in order if c in chosen and c in df.columns] or order[:default]))


def prefixed(df: DataFrame, columns: dict[str, str], raw: str | None = None, headers: list[str] = (), prefix: str = "") -> DataFrame:
    """Columns under new names (column -> label), then the named headers of a raw map, each under prefix."""
    chosen = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(label) for c, label in columns.items()]
    return df.select(*chosen, *[F.coalesce(F.col(raw)[h], F.lit("")).alias(f"{prefix}{h}") for h in headers])


def resolve_catalog(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key, ids array) to (key, terms array): the id before " - " stands for its terms (catalog: id, terms), an
    unknown one for itself; each term once, in order."""
    rows = asked.select("key", F.posexplode("ids").alias("at", "raw")).withColumn("id", F.trim(F.substring_index("raw", " - ", 1)))
    known = catalog.select("id", F.col("terms").alias("__terms"))
    rows = rows.join(known, "id", "left").select("key", "at", F.coalesce("__terms", F.array("raw")).alias("t"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x.t)  # a request's ids
    return rows.groupBy("key").agg(F.array_distinct(F.flatten(lists)).alias("terms"))


def yes_no(asked: Column, confirmed: Column) -> Column:
    """Confirmed, Check or Not requested."""
    return F.when(~asked, "Not requested").when(confirmed, "Confirmed").otherwise("Check")
