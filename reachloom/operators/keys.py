"""Keys of what is known already, and rows that they leave out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_profile_url, person_identity_key, text_of

# Fixed values of the data rules: headers of a person's name and company.
NAME_HEADERS = ("name", "person", "full name", "speaker")
COMPANY_HEADERS = ("company", "organization", "organisation", "employer")


def _header(df: DataFrame, names: tuple[str, ...]) -> str | None:
    return next((c for c in df.columns if c.strip().lower() in names), None)


def existing_url_keys(df: DataFrame) -> DataFrame:
    """Url: every cell of every column that is a profile's address, canonical, once each."""
    cells = F.explode(F.array(*[text_of(F.col(f"`{c}`")) for c in df.columns])).alias("cell")
    return df.select(cells).select(normalize_profile_url(F.col("cell")).alias("url")).where("url != ''").distinct()


def existing_people_keys(df: DataFrame) -> DataFrame:
    """Person: lower-case name and company of a table that has a name column; without one there are none."""
    name, company = _header(df, NAME_HEADERS), _header(df, COMPANY_HEADERS)
    if name is None:
        return df.sparkSession.createDataFrame([], "person string")
    low = lambda c: F.lower(F.trim(text_of(F.col(f"`{c}`")))) if c else F.lit("")
    return df.where(low(name) != "").select(F.concat(low(name), F.lit("|"), low(company)).alias("person")).distinct()


def exclusion_keys(df: DataFrame, import_id: str) -> DataFrame:
    """import_id, kind (url or identity), value: from every column whose bare header says LinkedIn, and from name and
    company."""
    links = [c for c in df.columns if re.search("link(?:e)?din", re.sub("[^a-z0-9]", "", c.lower()))]
    parts = [df.select(F.lit("url").alias("kind"), normalize_profile_url(text_of(F.col(f"`{c}`"))).alias("value")) for c in links]
    name, company = _header(df, NAME_HEADERS), _header(df, COMPANY_HEADERS)
    if name and company:
        parts.append(df.select(F.lit("identity").alias("kind"), person_identity_key(F.col(f"`{name}`"), F.col(f"`{company}`")).alias("value")))
    if not parts:
        return df.sparkSession.createDataFrame([], "import_id string, kind string, value string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value != ''").distinct().select(F.lit(import_id).alias("import_id"), "kind", "value")


def seed_scan(df: DataFrame, query: str, order: str, most: int) -> DataFrame:
    """The first `most` rows in which any word of the query (over two letters) occurs, in any column."""
    tokens = [t for t in re.sub(r"[\"'()]", " ", query.lower()).split() if len(t) > 2]
    text = F.lower(F.concat_ws(" ", *[text_of(F.col(f"`{c}`")) for c in df.columns]))
    hit: Column = F.lit(False)
    for t in tokens:
        hit = hit | F.contains(text, F.lit(t))
    return df.where(hit).orderBy(order).limit(most)


def exclude_existing(df: DataFrame, keys: DataFrame, column: str = "url") -> DataFrame:
    """Rows whose key isn't known; rows without a key stay."""
    known = keys.select(F.col(keys.columns[0]).alias("__known")).distinct()
    return df.join(known, F.col(column) == F.col("__known"), "left_anti")


def dedup_scope(df: DataFrame, seen: DataFrame, scope: str, job: str) -> DataFrame:
    """Rows new to a scope: job (not in this job's seen rows), global (not in any), none (all). seen: url, job."""
    if scope == "none":
        return df
    if scope not in ("job", "global"):
        raise ValueError(f"no such scope: {scope}")
    return exclude_existing(df, (seen.where(F.col("job") == job) if scope == "job" else seen).select("url"))
