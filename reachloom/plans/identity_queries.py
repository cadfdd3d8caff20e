"""Queries of the contact-list comparison, and their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity as I
from ..storage import saved
from . import twins as T
from .adapters import cte, frame


def _primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "primary_contacts")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "history_contacts")


#: The comparison's prepared tables by application and input: one application prepares an input once.
_ready: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame, DataFrame]] = {}


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ready:
        _ready[key] = I.prepared(_primary(spark, sf_dir), _history(spark, sf_dir))
    return _ready[key]


def c03(spark, sf_dir):
    return I.canonicalize(_primary(spark, sf_dir)).select(
        "record_id", "name_key", "company_key", "email_key", "phone_key", "profile_key", F.array_join("issues", ";").alias("issues"))


def c03_invalid(spark, sf_dir):
    return I.invalid_rows(saved(I.canonicalize(_primary(spark, sf_dir)), "primary"))


def w02(spark, sf_dir):
    return I.first_wins(I.named(saved(I.canonicalize(_primary(spark, sf_dir)), "primary"))).select("record_id", F.coalesce("duplicate_of", F.lit("")).alias("duplicate_of"))


def a14(spark, sf_dir):
    history = saved(I.named(I.canonicalize(_history(spark, sf_dir))), "history")
    return I.clustered(history).select("seq", "cluster")


def d06(spark, sf_dir):
    return _history(spark, sf_dir).select("seq", I.status_category(F.col("status")).alias("category"))


def d07(spark, sf_dir):
    _, history, _, _ = _prepared(spark, sf_dir)
    return I.cluster_summary(history).select("cluster", "records", "history_decision")


def j01(spark, sf_dir):
    primary, history, _, _ = _prepared(spark, sf_dir)
    sets = [F.array_join(F.col(f"by_{k}").cast("array<string>"), ";").alias(f"by_{k}") for k in I.IDENTIFIERS]
    return I.match_exact(primary, history).select("seq", *sets)


def j02(spark, sf_dir):
    primary, history, _, _ = _prepared(spark, sf_dir)
    return I.match_name_company(primary, history).select("seq", F.array_join(F.col("clusters").cast("array<string>"), ";").alias("clusters"))


def j03(spark, sf_dir):
    primary, history, _, _ = _prepared(spark, sf_dir)
    rest = primary.join(I.match_exact(primary, history).select("seq"), "seq", "left_anti")
    rest = rest.join(I.match_name_company(primary, history).select("seq"), "seq", "left_anti")
    return I.match_fuzzy(rest, history)


def _flat(matches: DataFrame) -> DataFrame:
    return matches.withColumn("clusters", F.array_join(F.col("clusters").cast("array<string>"), ";"))


def d08_exact(spark, sf_dir):
    primary, history, _, _ = _prepared(spark, sf_dir)
    return _flat(I.match_decisions(primary, history, fuzzy=False))


def d08(spark, sf_dir):
    primary, history, _, _ = _prepared(spark, sf_dir)
    return _flat(I.match_decisions(primary, history))


def _overrides(primary: DataFrame) -> DataFrame:
    action = F.expr("CASE seq % 9 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'MARK_DNC' WHEN 3 THEN 'MARK_SAFE' ELSE 'OTHER' END")
    return primary.select("seq", action.alias("action"))


def d09(spark, sf_dir):
    primary, history, _, _ = _prepared(spark, sf_dir)
    matches = saved(I.match_decisions(primary, history), "matches")
    return _flat(I.apply_review(matches, _overrides(primary), I.cluster_summary(history)))


def a03(spark, sf_dir):
    primary, history, duplicates, invalid = _prepared(spark, sf_dir)
    matches = saved(I.match_decisions(primary, history, fuzzy=False), "matches")
    return I.run_metrics(primary, history, matches, duplicates, invalid)


def a03_fuzzy(spark, sf_dir):
    primary, history, duplicates, invalid = _prepared(spark, sf_dir)
    return I.run_metrics(primary, history, saved(I.match_decisions(primary, history), "matches"), duplicates, invalid)


def u02(spark, sf_dir):
    primary, history, _, _ = _prepared(spark, sf_dir)
    matches = saved(I.match_decisions(primary, history, fuzzy=False), "matches")
    return I.combined_master(primary, history, matches)


def u04(spark, sf_dir, fuzzy: bool = False):
    """Rows of each result sheet."""
    primary, history, _, invalid = _prepared(spark, sf_dir)
    m = saved(I.match_decisions(primary, history, fuzzy=fuzzy), "matches")
    linked = m.where("confirmed").select("seq", F.explode("clusters").alias("cluster")).join(history.select("cluster"), "cluster")
    any_link = m.select("seq", F.explode("clusters").alias("cluster")).join(history.select("cluster"), "cluster")
    sheets = {
        "fresh": m.where("decision = 'SAFE_TO_CONTACT'"), "common": linked, "history": any_link,
        "review": m.where("decision IN ('REVIEW_REQUIRED', 'POSSIBLE_MATCH')"), "invalid": invalid,
    }
    out = None
    for name, df in sheets.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sheet"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def u04_fuzzy(spark, sf_dir):
    return u04(spark, sf_dir, fuzzy=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "C03_canonicalize": c03, "C03_invalid_rows": c03_invalid, "W02_first_wins_dedupe": w02, "A14_identity_clusters": a14,
    "D06_status_category": d06, "D07_decision_from_history": d07, "J01_match_exact": j01, "J02_match_name_company": j02,
    "J03_match_fuzzy": j03, "D08_match_decision": d08, "D08_match_decision_exact": d08_exact, "D09_apply_review": d09,
    "A03_run_metrics": a03, "A03_run_metrics_fuzzy": a03_fuzzy, "U02_combined_master": u02, "U04_result_sheets": u04,
    "U04_result_sheets_fuzzy": u04_fuzzy,
}


def keyed(name: str, source: str) -> str:
    return (f"{name} AS MATERIALIZED (SELECT *, {T.n02('full_name')} AS name_key, {T.n03('company')} AS company_key, "
            f"{T.n04('email')} AS email_key, {T.n05('phone')} AS phone_key, {T.n06('profile_url')} AS profile_key "
            f"FROM {source})")  # fmt: skip


def category(status: str) -> str:
    t = T.n02(status)
    arms = [f"WHEN {t} = '' THEN 'UNKNOWN'"]
    for name, terms in I.STATUS_RULES:
        arms.append("WHEN " + " OR ".join(f"contains({t}, '{x}')" for x in terms) + f" THEN '{name}'")
    return "CASE " + " ".join(arms) + " ELSE 'UNKNOWN' END"


P = cte("primary_contacts") + ",\n" + keyed("pk", "primary_contacts")
_ISSUES = [
    ("trim(email) <> '' AND email_key = ''", "malformed_email"), ("trim(phone) <> '' AND phone_key = ''", "malformed_phone"),
    ("trim(profile_url) <> '' AND profile_key = ''", "invalid_profile_url"),
]
_WEAK = ("email_key = '' AND phone_key = '' AND profile_key = '' AND company_key = ''", "weak_identity_name_only")
_ID = "source_id || ':' || CAST(seq AS VARCHAR)"
_BEST = ("CASE WHEN phone_key <> '' THEN 'phone:' || phone_key WHEN email_key <> '' THEN 'email:' || email_key "
         "WHEN profile_key <> '' THEN 'profile:' || profile_key WHEN company_key <> '' THEN 'nc|' || name_key || '|' || company_key "
         "END")  # fmt: skip
_DEDUPED = f""",
pn AS (SELECT *, {_ID} AS record_id, {_BEST} AS best FROM pk WHERE name_key <> ''),
pd AS (SELECT *, row_number() OVER w AS rn, first_value(record_id) OVER w AS first_id FROM pn
  WINDOW w AS (PARTITION BY coalesce(best, record_id) ORDER BY seq, record_id)),
prim AS (SELECT * FROM pd WHERE rn = 1)"""
H = ",\n" + cte("history_contacts").removeprefix("WITH RECURSIVE ") + ",\n" + keyed("hk", "history_contacts") + """,
hn AS (SELECT * FROM hk WHERE name_key <> ''),
ids AS (SELECT seq, 'phone' AS kind, phone_key AS value FROM hn WHERE phone_key <> ''
  UNION ALL SELECT seq, 'email', email_key FROM hn WHERE email_key <> ''
  UNION ALL SELECT seq, 'profile', profile_key FROM hn WHERE profile_key <> ''),
anchor AS (SELECT *, first_value(seq) OVER w AS a_seq, first_value(phone_key) OVER w AS a_phone,
  first_value(email_key) OVER w AS a_email, first_value(profile_key) OVER w AS a_profile
  FROM hn WHERE company_key <> '' WINDOW w AS (PARTITION BY name_key, company_key ORDER BY seq)),
links AS (SELECT seq AS a, min(seq) OVER (PARTITION BY kind, value) AS b FROM ids
  UNION SELECT seq, a_seq FROM anchor WHERE NOT (
    (phone_key <> '' AND a_phone <> '' AND phone_key <> a_phone) OR (email_key <> '' AND a_email <> '' AND email_key <> a_email)
    OR (profile_key <> '' AND a_profile <> '' AND profile_key <> a_profile))),
ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(seq, other) AS (SELECT a, b FROM ways UNION SELECT reach.seq, ways.b FROM reach JOIN ways ON reach.other = ways.a),
clusters AS (SELECT hn.seq, least(hn.seq, coalesce(min(other), hn.seq)) AS cluster FROM hn LEFT JOIN reach ON reach.seq = hn.seq
  GROUP BY hn.seq),
hist AS (SELECT hn.*, cluster, """ + category("status") + """ AS category FROM hn JOIN clusters USING (seq)),
summary AS (SELECT cluster, count(*) AS records, CASE WHEN bool_or(category = 'DO_NOT_CONTACT') THEN 'DO_NOT_CONTACT'
  WHEN bool_or(category IN ('CONTACTED', 'POSITIVE_RESPONSE', 'NEGATIVE_RESPONSE', 'NO_RESPONSE')) THEN 'ALREADY_CONTACTED'
  WHEN bool_and(category = 'SAFE_OR_RECONTACT_ALLOWED') THEN 'SAFE_TO_CONTACT' ELSE 'REVIEW_REQUIRED' END AS history_decision
  FROM hist GROUP BY cluster)"""  # fmt: skip
M = """,
hid AS (SELECT DISTINCT kind, value, cluster FROM ids JOIN clusters USING (seq)),
pid AS (SELECT seq, 'phone' AS kind, phone_key AS value FROM prim WHERE phone_key <> ''
  UNION ALL SELECT seq, 'email', email_key FROM prim WHERE email_key <> ''
  UNION ALL SELECT seq, 'profile', profile_key FROM prim WHERE profile_key <> ''),
hits AS (SELECT DISTINCT seq, kind, cluster FROM pid JOIN hid USING (kind, value)),
exact AS (SELECT seq, bool_or(kind = 'phone') AS ph, bool_or(kind = 'email') AS em, count(DISTINCT cluster) AS n,
  list_sort(list(DISTINCT cluster)) AS cl FROM hits GROUP BY seq),
pairs AS (SELECT DISTINCT e.seq, array_to_string(list_sort(string_split(p.name_key, ' ')), ' ') AS x,
  array_to_string(list_sort(string_split(h.name_key, ' ')), ' ') AS y
  FROM exact e JOIN prim p USING (seq) JOIN hist h ON h.cluster = e.cl[1] WHERE e.n = 1),
clash AS (SELECT seq FROM pairs GROUP BY seq HAVING max(""" + T.token_sort_ratio("x", "y") + """) < 60),
nc AS (SELECT p.seq, list_sort(list(DISTINCT h.cluster)) AS cl FROM prim p JOIN hist h USING (name_key, company_key)
  WHERE p.company_key <> '' GROUP BY p.seq),
matches AS (SELECT p.seq,
  CASE WHEN e.seq IS NOT NULL THEN CASE WHEN ph THEN 'EXACT_PHONE' WHEN em THEN 'EXACT_EMAIL' ELSE 'EXACT_PROFILE' END
    WHEN nc.seq IS NOT NULL THEN 'NAME_COMPANY_MATCH' ELSE 'NO_MATCH' END AS match_type,
  CASE WHEN e.n > 1 THEN 70 WHEN k.seq IS NOT NULL THEN 75 WHEN e.n = 1 THEN CASE WHEN ph THEN 100 WHEN em THEN 99 ELSE 98 END
    WHEN len(nc.cl) = 1 THEN 90 WHEN len(nc.cl) > 1 THEN 70 ELSE 0 END AS confidence,
  coalesce(e.cl, nc.cl, []) AS clusters,
  CASE WHEN e.n > 1 OR k.seq IS NOT NULL OR (e.seq IS NULL AND len(nc.cl) > 1) THEN 'REVIEW_REQUIRED'
    WHEN e.n = 1 OR len(nc.cl) = 1 THEN s.history_decision ELSE 'SAFE_TO_CONTACT' END AS decision,
  coalesce(e.n = 1 AND k.seq IS NULL, len(nc.cl) = 1, false) AS confirmed
  FROM prim p LEFT JOIN exact e USING (seq) LEFT JOIN nc USING (seq) LEFT JOIN clash k USING (seq)
  LEFT JOIN summary s ON s.cluster = coalesce(e.cl, nc.cl)[1])"""
ALL = P + _DEDUPED + H
BOTH = ALL + M

ORACLES: dict[str, str] = {
    "C03_canonicalize": P + f"SELECT {_ID} AS record_id, name_key, company_key, email_key, phone_key, profile_key, concat_ws(';', "
    + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in [*_ISSUES, _WEAK]) + ") AS issues FROM pk",
    "C03_invalid_rows": P + f"SELECT {_ID} AS record_id, 'missing_identity_name' AS reason, 'REJECTED' AS disposition FROM pk WHERE name_key = ''"
    + "".join(f" UNION ALL SELECT {_ID}, '{n}', 'PROCESSED_WITH_WARNING' FROM pk WHERE name_key <> '' AND {c}" for c, n in _ISSUES),
    "W02_first_wins_dedupe": P + _DEDUPED + "SELECT record_id, CASE WHEN best IS NOT NULL AND rn > 1 THEN first_id ELSE '' END AS duplicate_of FROM pd",
    "A14_identity_clusters": ALL + "SELECT seq, cluster FROM clusters",
    "D06_status_category": cte("history_contacts") + f"SELECT seq, {category('status')} AS category FROM history_contacts",
    "D07_decision_from_history": ALL + "SELECT cluster, records, history_decision FROM summary",
    "J01_match_exact": BOTH + "SELECT seq, " + ", ".join(
        f"coalesce(array_to_string(list_sort(list(DISTINCT cluster) FILTER (kind = '{k}')), ';'), '') AS by_{k}" for k in I.IDENTIFIERS)
    + " FROM hits GROUP BY seq",
    "J02_match_name_company": BOTH + "SELECT seq, array_to_string(cl, ';') AS clusters FROM nc",
    "D08_match_decision_exact": BOTH + "SELECT seq, match_type, confidence, array_to_string(clusters, ';') AS clusters, decision, confirmed FROM matches",
    "A03_run_metrics": BOTH + """,
      unseen AS (SELECT DISTINCT cluster FROM hist WHERE cluster NOT IN (SELECT unnest(clusters) FROM matches WHERE confirmed))
      SELECT 'primary_prospects' AS metric, count(*) AS value FROM prim UNION ALL SELECT 'previous_records', count(*) FROM hist
      UNION ALL SELECT 'duplicates', count(*) FROM pd WHERE rn > 1
      UNION ALL SELECT 'unique_people', (SELECT count(*) FROM prim) + (SELECT count(*) FROM unseen)
      UNION ALL SELECT 'common_people', count(*) FROM matches WHERE confirmed
      UNION ALL SELECT 'invalid_rows', count(*) FROM pk WHERE name_key = ''"""
    + "".join(f" UNION ALL SELECT '{n}', count(*) FROM matches WHERE decision = '{d}'" for d, n in (
        ("SAFE_TO_CONTACT", "safe_to_contact"), ("ALREADY_CONTACTED", "already_contacted"), ("DO_NOT_CONTACT", "do_not_contact"),
        ("POSSIBLE_MATCH", "possible_matches"), ("REVIEW_REQUIRED", "review_required"))),
    "U02_combined_master": BOTH + """,
      per AS (SELECT cluster, arg_min(full_name, seq) AS full_name, arg_min(company, seq) AS company,
        coalesce(string_agg(status, ' | ' ORDER BY seq) FILTER (status <> ''), '') AS statuses, count(*) AS interactions
        FROM hist GROUP BY cluster),
      linked AS (SELECT seq, unnest(clusters) AS cluster FROM matches WHERE confirmed)
      SELECT 'p' || CAST(p.seq AS VARCHAR) AS person, p.full_name, p.company,
        CASE WHEN l.seq IS NULL THEN 'PRIMARY_ONLY' ELSE 'BOTH' END AS presence, coalesce(per.statuses, '') AS statuses,
        coalesce(per.interactions, 0) AS interactions
      FROM prim p LEFT JOIN linked l USING (seq) LEFT JOIN per USING (cluster)
      UNION ALL SELECT 'h' || CAST(cluster AS VARCHAR), full_name, company, 'PREVIOUS_ONLY', statuses, interactions FROM per
      WHERE cluster NOT IN (SELECT cluster FROM linked)""",
    "U04_result_sheets": BOTH + """,
      l AS (SELECT seq, unnest(clusters) AS cluster, confirmed FROM matches)
      SELECT 'fresh' AS sheet, count(*) AS n FROM matches WHERE decision = 'SAFE_TO_CONTACT'
      UNION ALL SELECT 'common', count(*) FROM l JOIN hist USING (cluster) WHERE confirmed
      UNION ALL SELECT 'history', count(*) FROM l JOIN hist USING (cluster)
      UNION ALL SELECT 'review', count(*) FROM matches WHERE decision IN ('REVIEW_REQUIRED', 'POSSIBLE_MATCH')
      UNION ALL SELECT 'invalid', (SELECT count(*) FROM pk WHERE name_key = '')"""
    + "".join(f" + (SELECT count(*) FROM pk WHERE name_key <> '' AND {c})" for c, _ in _ISSUES),
}
