"""Candidates from search results: fragments merged by profile, filters of a request, confidence, accepted and rejected.

A candidate row has seq (the order in which it came), url (canonical or empty), name, designation, company, title,
body, evidence, sources (array). Text is read whole unless a rule names a length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import all_terms, any_of, any_term, business_model_match, clean_identity, company_match_strength, first_reason
from ..functions.taxonomy import Taxonomy, first_place, industry_match, location_match, role_match_strength, role_matches
from ..functions.text import bound, clean_spaces, independent_families, normalize_text, profile_id, words
from ..storage import saved

# Fixed values of the data rules.
UNKNOWN = ("", "unknown", "none", "na", "n a")
ROLE_MARKERS = ("chief", "customer", "director", "engineer", "head", "lead", "leader", "manager", "officer", "president",
                "success", "technology", "vice", "vp")
NO_NAMES = ("", "unknown", "linkedin member", "new cio", "new cto", "new cdo")
REVIEWABLE = ("company_mismatch", "designation_mismatch", "invalid_name")


@dataclass(frozen=True)
class Request:
    """What a run asks for. Lists are a person's settings."""

    roles: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    industries: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    business_model: str = "Any"
    require_company: bool = False
    least_confidence: int = 0
    least_sources: int = 1
    role_names: Taxonomy = Taxonomy()
    place_names: Taxonomy = Taxonomy()


def field_quality(kind: str, value: Column) -> Column:
    """How good a name, designation or company looks; 0 is worst."""

    def base(key: Column) -> Column:
        return F.when(key.isin(*UNKNOWN), 0).when(F.size(words(key)) > 18, 1).otherwise(10)

    def name(key: Column) -> Column:
        n = F.size(words(key))
        bad = (base(key) == 0) | ~n.between(2, 6) | value.rlike(r"\d|@")
        return F.when(bad, 0).otherwise(base(key) + F.greatest(F.lit(0), 7 - F.abs(n - 2)))

    def designation(key: Column) -> Column:
        marks = F.size(F.filter(words(key), lambda w: w.isin(*ROLE_MARKERS)))
        long = F.greatest(F.lit(0), F.size(words(key)) - 10)
        return F.when(base(key) == 0, 0).otherwise(base(key) + 3 * marks - long)

    def company(key: Column) -> Column:
        n = F.size(words(key))
        return F.when((base(key) == 0) | (n > 8), 0).otherwise(base(key) + F.greatest(F.lit(0), 6 - n))

    return bound(normalize_text(value), {"name": name, "designation": designation, "company": company}[kind]).cast("int")


def merge_candidates(rows: DataFrame, most: int = 1800) -> DataFrame:
    """One row for each url: the best name, designation and company (the first of equals), all sources and
    queries, evidence and body joined in order and cut at `most` characters, the first title."""
    order = F.negative("seq")
    best = [F.max_by(c, F.struct(field_quality(c, F.col(c)), order)).alias(c) for c in ("name", "designation", "company")]
    one = rows.where("url != ''").groupBy("url").agg(
        F.min("seq").alias("seq"), *best,
        F.min_by("title", F.struct(F.col("title") == "", "seq")).alias("title"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.array_sort(F.collect_set("query")).alias("queries"),
    )
    for c in ("evidence", "body"):
        one = one.join(_joined_text(rows, c, most), "url", "left").withColumn(c, F.coalesce(c, F.lit("")))
    return one


def _joined_text(rows: DataFrame, column: str, most: int) -> DataFrame:
    """url and the fragments of a column joined by a space in order, cut at `most` characters.

    A fragment and its space take two characters or more, so the first most / 2 of a url are all that can count; that
    limit is applied in each task before rows move.
    """
    parts = rows.where("url != ''").select("url", "seq", F.substring(clean_spaces(F.col(column)), 1, most).alias("t")).where("t != ''")
    n = F.row_number().over(Window.partitionBy("url").orderBy("seq"))
    parts = parts.withColumn("n", n).where(F.col("n") <= most // 2 + 1)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda e: e.t), " ")
    return parts.groupBy("url").agg(F.substring(whole, 1, most).alias(column))


def _evidence(*columns: str) -> Column:
    return clean_spaces(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def filter_reason(request: Request) -> Column:
    """The first filter of the request that a candidate fails, else empty. Needs company_evidence besides the
    candidate's columns."""
    everything = _evidence("name", "designation", "company", "title", "body", "evidence", "company_evidence")
    checks = []
    if request.exclude:
        checks.append(("excluded_terms", any_term(everything, request.exclude)))
    if request.include:
        checks.append(("required_terms", ~all_terms(everything, request.include)))
    checks.append(("role", ~role_matches(F.col("designation"), request.roles, request.role_names)))
    if request.require_company and request.companies:
        known = any_of([company_match_strength(F.col("company"), F.lit(c)) > 0 for c in request.companies])
        checks.append(("target_company", ~known))
    place = location_match(_evidence("title", "body", "evidence"), request.locations, request.place_names)
    checks.append(("location", place == ""))
    checks.append(("industry_company", ~industry_match(_evidence("company", "designation", "evidence", "company_evidence"), request.industries)))
    checks.append(("business_model", ~business_model_match(_evidence("company", "evidence", "company_evidence"), F.lit(request.business_model))))
    return first_reason(checks)


def confidence_score(request: Request) -> Column:
    """D01."""
    points = lambda c, n: F.when(c, n).otherwise(0)
    total = F.lit(50)
    if request.roles:
        total = total + points(role_matches(F.col("designation"), request.roles, request.role_names), 15)
    if request.companies:
        total = total + points(any_of([company_match_strength(F.col("company"), F.lit(c)) > 0 for c in request.companies]), 12)
    if request.locations:
        total = total + points(location_match(_evidence("title", "body", "evidence"), request.locations, request.place_names) != "", 10)
    if request.industries:
        total = total + points(industry_match(_evidence("company", "designation", "evidence", "company_evidence"), request.industries), 8)
    total = total + points(F.size("sources") > 1, 5) + points(F.col("company_evidence") != "", 3)
    if request.business_model.strip().lower() not in ("", "any"):
        total = total + 4
    return F.least(F.lit(99), total)


def raw_score(request: Request) -> Column:
    """Points for each role, the place, each industry's own name and a known company."""
    text = _evidence("designation", "company", "evidence")
    total = F.lit(0)
    for r in request.roles:
        total = total + F.when(role_match_strength(F.col("designation"), r, request.role_names) > 0, 5).otherwise(0)
    total = total + F.when(first_place(text, request.locations, request.place_names) != "", 4).otherwise(0)
    for i in request.industries:
        total = total + F.when(any_term(text, [i]), 3).otherwise(0)
    return total + F.when(F.lower("company") != "unknown", 2).otherwise(0)


def evidence_needed(request: Request) -> Column:
    """Industries are asked for, the row shows none of them, its company is known and isn't one of the requested."""
    if not request.industries:
        return F.lit(False)
    listed = any_term(F.col("company"), request.companies) if request.companies else F.lit(False)
    shown = any_term(F.col("evidence"), request.industries)
    return ~listed & ~shown & ~F.lower(clean_spaces(F.col("company"))).isin("", "unknown")


def validate(rows: DataFrame, request: Request, known_urls: DataFrame | None = None) -> DataFrame:
    """Rows with reason (empty: accepted), and for accepted ones location, profile_id, source, confidence and
    evidence (1,200 characters; rejected: 900). known_urls: url, of profiles that are there already.

    Rows are taken in the order of seq: once a url is accepted, its later rows are duplicates.
    """
    df = rows
    if known_urls is not None:
        df = df.join(known_urls.select("url", F.lit(True).alias("__known")).distinct(), "url", "left")
    else:
        df = df.withColumn("__known", F.lit(None).cast("boolean"))
    own = first_reason([
        ("invalid_linkedin_url", F.col("url") == ""),
        ("duplicate", F.coalesce("__known", F.lit(False))),
        ("incomplete", ~clean_identity(F.col("name"), F.col("designation"), F.col("company"))),
    ])
    asked = filter_reason(request)
    score = confidence_score(request)
    late = first_reason([
        ("source_count", independent_families(F.col("sources")) < max(1, request.least_sources)),
        ("confidence", F.col("confidence") < request.least_confidence),
    ])
    df = df.withColumn("confidence", score)
    df = df.withColumn("__own", F.coalesce(F.nullif(own, F.lit("")), F.nullif(asked, F.lit("")), late))
    df = saved(df, "judged")
    firsts = df.where("__own = ''").groupBy(F.col("url").alias("__u")).agg(F.min("seq").alias("__first"))
    df = df.join(firsts, F.col("url") == F.col("__u"), "left")
    reason = F.when((F.col("__own") != "invalid_linkedin_url") & (F.col("seq") > F.col("__first")), "duplicate").otherwise(F.col("__own"))
    accepted = reason == ""
    evidence = F.when(accepted, F.substring(_evidence("evidence", "company_evidence"), 1, 1200)).otherwise(
        F.substring(_evidence("evidence"), 1, 900))
    place = location_match(_evidence("title", "body", "evidence"), request.locations, request.place_names)
    return df.select(
        "seq", "url", clean_spaces(F.col("name")).alias("name"), clean_spaces(F.col("designation")).alias("designation"),
        clean_spaces(F.col("company")).alias("company"), reason.alias("reason"),
        F.when(accepted, place).otherwise("").alias("location"), F.when(accepted, profile_id(F.col("url"))).otherwise("").alias("profile_id"),
        F.array_join(F.array_sort("sources"), ", ").alias("source"), F.when(accepted, F.col("confidence")).alias("confidence"), evidence.alias("evidence"),
    )


def poc_match(rows: DataFrame, company: str, designation: str, request: Request) -> DataFrame:
    """Rows with reason, score (accepted rows) and reviewable, for one company and role of a request. A url's
    later rejections are left out."""
    everything = _evidence("name", "designation", "company", "title", "body", "evidence")
    strength = company_match_strength(F.col("company"), F.lit(company))
    role = role_match_strength(F.col("designation"), designation, request.role_names)
    key = normalize_text(F.col("name"))
    n = F.size(words(key))
    checks = [("invalid_name", key.isin(*NO_NAMES) | ~n.between(2, 8) | F.col("name").rlike(r"\d|@"))]
    if request.exclude:
        checks.append(("excluded_terms", any_term(everything, request.exclude)))
    if request.include:
        checks.append(("required_terms", ~all_terms(everything, request.include)))
    checks += [("company_mismatch", strength == 0), ("designation_mismatch", role == 0)]
    if request.locations:
        place = location_match(_evidence("title", "body", "evidence"), request.locations[:1], request.place_names)
        checks.append(("location_mismatch", place == ""))
    made = rows.where("url != ''").select("*", strength.alias("__c"), role.alias("__r"), first_reason(checks).alias("reason"))
    score = F.least(F.lit(96), 68 + 4 * F.col("__c") + 4 * F.col("__r") + F.when(F.size("sources") > 1, 4).otherwise(0))
    made = saved(made.withColumn("score", F.when(F.col("reason") == "", score)).drop("__c", "__r"), "poc")
    first = made.groupBy(F.col("url").alias("__u")).agg(
        F.min(F.when(F.col("reason") == "", F.col("seq"))).alias("__ok"), F.min(F.when(F.col("reason") != "", F.col("seq"))).alias("__no"))
    made = made.join(first, F.col("url") == F.col("__u"))
    stays = (F.col("seq") == F.col("__ok")) | ((F.col("seq") == F.col("__no")) & (F.col("__ok").isNull() | (F.col("__no") < F.col("__ok"))))
    return made.where(stays).drop("__u", "__ok", "__no").withColumn("reviewable", F.col("reason").isin(*REVIEWABLE))
