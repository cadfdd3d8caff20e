"""Table operators written as SQL over the adapters: candidates, aggregates, windows, joins, scores, campaigns, events.

Each entry is (sources, Spark SQL, twin); a twin of None means the same text serves both. Sources are adapters, given
tables or the derived rows below; Spark gets them as DataFrames, the twin as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .adapters import ADAPTERS, frame

#: Derived rows in SQL that reads alike in both engines: name -> (sources, query).
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    # A result title is "name - role at company" (or with a bar, or @).
    "candidates": (
        ("search_rows",),
        """
        SELECT seq, page, pos, title, body, source, query, url, name, coalesce(nullif(role, ''), 'Unknown') AS designation,
          coalesce(nullif(company, ''), 'Unknown') AS company FROM (
          SELECT *, trim(regexp_extract(headline, '^([^~]*?) (?:at|@) ', 1)) AS role,
            trim(regexp_extract(headline, ' (?:at|@) ([^~]*)$', 1)) AS company FROM (
            SELECT *, trim(regexp_extract(title, '^([^~|]*?) [|-] ', 1)) AS name,
              trim(regexp_extract(title, '^[^~|]*? [|-] ([^~]*)$', 1)) AS headline,
              CASE WHEN contains(lower(href), 'linkedin.com/in/')
                THEN 'https://www.linkedin.com/in/' || lower(regexp_extract(href, '/in/([^/?#]+)', 1)) || '/' ELSE '' END AS url
            FROM {search_rows}) a) b""",
    ),
    # One event for each provider id, the first to arrive.
    "distinct_events": (
        ("message_events",),
        """SELECT id, recipient_id, campaign_id, event_type, occurred_at, provider_event_id FROM (
          SELECT *, row_number() OVER (PARTITION BY provider_event_id ORDER BY occurred_at, id) AS n FROM {message_events}) e WHERE n = 1""",
    ),
}

ENTRIES: dict[str, tuple[tuple[str, ...], str, str | None]] = {}


def add(name: str, sources: str, query: str, twin: str | None = None) -> None:
    ENTRIES[name] = (tuple(sources.split()), query, twin)


add("X05_results_from_records", "search_rows", """
  SELECT query, href, seq FROM (SELECT *, row_number() OVER (PARTITION BY query, href ORDER BY seq) AS n FROM {search_rows}) r WHERE n = 1""")
add("A02_merge_partial_profiles", "candidates", """
  SELECT url, max_by(name, CASE WHEN name IN ('', 'Unknown') THEN -1 ELSE seq END) AS name,
    max_by(designation, length(designation) * CAST(1000000 AS BIGINT) + seq) AS designation,
    substr(max_by(title, seq), 1, 420) AS title FROM {candidates} WHERE url <> '' GROUP BY url""")
add("A04_rejection_histogram", "candidates", """
  SELECT reason, count(*) AS n FROM (SELECT CASE WHEN url = '' THEN 'invalid_linkedin_url' WHEN name = '' THEN 'incomplete'
    WHEN company = 'Unknown' THEN 'target_company' WHEN designation = 'Unknown' THEN 'role' ELSE 'accepted' END AS reason FROM {candidates}) r
  GROUP BY reason""")
add("A05_status_counts", "recipients", "SELECT status, count(*) AS n FROM {recipients} GROUP BY status")
add("A06_campaign_funnel", "recipients", """
  SELECT campaign_id, count(*) AS total, count(*) FILTER (WHERE status IN ('SENT', 'OPENED', 'CLICKED', 'REPLIED')) AS sent,
    count(*) FILTER (WHERE status IN ('OPENED', 'CLICKED', 'REPLIED')) AS opened, count(*) FILTER (WHERE status = 'CLICKED') AS clicked,
    count(*) FILTER (WHERE status = 'REPLIED') AS replied, count(*) FILTER (WHERE status = 'BOUNCED') AS bounced,
    count(*) FILTER (WHERE status = 'UNSUBSCRIBED') AS unsubscribed FROM {recipients} GROUP BY campaign_id""")
add("A07_provider_outcomes", "events", """
  SELECT event_type AS source, count(*) AS attempts, count(*) FILTER (WHERE value > 20) AS successful,
    count(*) FILTER (WHERE value <= 1) AS empty, sum(CAST(floor(value) AS BIGINT)) AS results FROM {events} GROUP BY event_type""")
add("A12_value_statistics", "lead_rows", """
  SELECT industry, count(*) AS n, count(DISTINCT country) AS countries, avg(seq) AS mean_seq,
    count(*) FILTER (WHERE seniority IN ('CEO', 'CTO')) AS high_intent FROM {lead_rows} GROUP BY industry""")
add("A13_distinct_statuses", "history_contacts", "SELECT DISTINCT status FROM {history_contacts} WHERE trim(status) <> ''")
add("A15_page_fingerprint", "candidates", """
  SELECT query, page, sha2(array_join(array_sort(collect_set(url)), '|'), 256) AS fingerprint FROM {candidates} WHERE url <> '' GROUP BY query, page""", """
  SELECT query, page, sha256(array_to_string(list_sort(list(DISTINCT url)), '|')) AS fingerprint FROM {candidates} WHERE url <> '' GROUP BY query, page""")
add("W03_best_wins_dedupe", "candidates", """
  SELECT url, seq FROM (SELECT url, seq, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN designation <> 'Unknown' THEN 1 ELSE 0 END DESC, seq) AS n
  FROM {candidates} WHERE url <> '') r WHERE n = 1""")
add("W07_group_anchor", "history_contacts", """
  SELECT seq, first_value(seq) OVER (PARTITION BY full_name, company ORDER BY seq) AS anchor FROM {history_contacts}""")
add("W08_repeat_page_flag", "candidates", """
  SELECT query, page, max(CASE WHEN page = first_page THEN 1 ELSE 0 END) = 0 AS repeats FROM (
    SELECT query, page, min(page) OVER (PARTITION BY query, url) AS first_page FROM {candidates} WHERE url <> '') p GROUP BY query, page""")
add("O02_contact_order", "primary_contacts", """
  SELECT phone, max(CASE WHEN email <> '' THEN 2 ELSE 1 END) AS confidence, min(seq) AS first_seq FROM {primary_contacts} WHERE phone <> '' GROUP BY phone""")
add("O03_keyset_page", "events", "SELECT event_id, event_type FROM {events} WHERE event_id > 500 ORDER BY event_id LIMIT 200")
add("O04_due_batch", "recipients", "SELECT id, campaign_id FROM {recipients} WHERE status = 'QUEUED' AND minute <= 30 ORDER BY minute, id LIMIT 50")
add("O06_pool_target", "candidates", """
  SELECT greatest(4 * 25, 25 + 25) AS target, count(*) FILTER (WHERE url <> '' AND designation <> 'Unknown') AS relevant FROM {candidates}""")
add("U01_union_sources", "primary_contacts history_contacts", """
  SELECT seq, source_id, full_name, '' AS owner FROM {primary_contacts} UNION ALL SELECT seq, source_id, full_name, owner FROM {history_contacts}""")
add("U03_except_intersect", "primary_contacts history_contacts", """
  SELECT 'only_new' AS part, count(*) AS n FROM (SELECT lower(email) AS e FROM {primary_contacts} WHERE email <> '' EXCEPT SELECT email FROM {history_contacts}) a
  UNION ALL SELECT 'both', count(*) FROM (SELECT lower(email) AS e FROM {primary_contacts} WHERE email <> '' INTERSECT SELECT email FROM {history_contacts}) b""")
add("J07_attach_company_evidence", "candidates", """
  SELECT c.seq, coalesce(e.n, 0) AS evidence FROM {candidates} c LEFT JOIN (SELECT lower(company) AS k, count(*) AS n FROM {candidates}
    WHERE company <> 'Unknown' GROUP BY lower(company)) e ON e.k = lower(c.company)""")
add("J09_link_click_join", "message_events recipients", """
  SELECT e.id, r.email, e.event_type FROM {message_events} e JOIN {recipients} r ON r.id = e.recipient_id WHERE e.event_type = 'CLICKED'""")
add("J10_job_results", "candidates", """
  SELECT c.seq, l.first_seq FROM {candidates} c JOIN (SELECT url, min(seq) AS first_seq FROM {candidates} WHERE url <> '' GROUP BY url) l ON l.url = c.url""")
add("J11_recheck_before_send", "recipients", """
  SELECT id FROM {recipients} d WHERE status = 'QUEUED' AND EXISTS (SELECT 1 FROM {recipients} o WHERE o.email = d.email AND o.id <> d.id
    AND o.status IN ('SENT', 'OPENED', 'CLICKED', 'REPLIED', 'BOUNCED', 'UNSUBSCRIBED'))""")
add("J12_task_matrix", "lead_rows region", """
  SELECT c.country, r.r_name AS location, s.seniority FROM (SELECT DISTINCT country FROM {lead_rows}) c CROSS JOIN {region} r
  CROSS JOIN (SELECT DISTINCT seniority FROM {lead_rows}) s""")
add("J14_awaiting_review", "candidates", """
  SELECT seq FROM {candidates} c WHERE url <> '' AND NOT EXISTS (SELECT 1 FROM {candidates} l WHERE l.url = c.url AND l.designation <> 'Unknown')""")
add("J16_flag_strict", "candidates", """
  SELECT c.seq, s.url IS NOT NULL AS strict FROM {candidates} c LEFT JOIN (SELECT DISTINCT url FROM {candidates} WHERE designation <> 'Unknown' AND url <> '') s ON s.url = c.url""")
_SENIOR = "CASE seniority WHEN 'CEO' THEN 100 WHEN 'CTO' THEN 95 WHEN 'VP' THEN 75 WHEN 'Director' THEN 65 WHEN 'Managing Director' THEN 98 ELSE 60 END"
_INDUSTRY = "CASE industry WHEN 'FinTech' THEN 95 WHEN 'SaaS' THEN 92 WHEN 'Retail' THEN 70 WHEN 'Energy' THEN 68 ELSE 65 END"
_STAGE = "CASE company_stage WHEN 'Unicorn (>$1B)' THEN 100 WHEN 'Mid-Market (500-5K)' THEN 75 WHEN 'Early Stage (<100)' THEN 40 ELSE 60 END"
_EVENT = "least(100, 15 + CASE WHEN speaker = 'Yes' THEN 40 ELSE 0 END + CASE WHEN podcast = 'Yes' THEN 20 ELSE 0 END + CASE WHEN awards NOT IN ('None', '') THEN 25 ELSE 0 END)"
_BUY = "least(100, 30 + CASE WHEN funding NOT IN ('', 'N/A', 'Bootstrapped') THEN 30 ELSE 0 END + CASE ai_signals WHEN 'High' THEN 25 WHEN 'Medium' THEN 15 ELSE 0 END)"
_SCORES = f"""
  SELECT seq, e AS event_invitation, dm, sales, net, partnership, CAST(ROUND(dm * CAST(0.35 AS DOUBLE) + sales * CAST(0.30 AS DOUBLE) + net * CAST(0.20 AS DOUBLE) + e * CAST(0.15 AS DOUBLE)) AS INT) AS overall
  FROM (SELECT seq, e, CAST(ROUND(s * CAST(0.35 AS DOUBLE) + i * CAST(0.20 AS DOUBLE) + c * CAST(0.25 AS DOUBLE) + e * CAST(0.10 AS DOUBLE) + b * CAST(0.10 AS DOUBLE)) AS INT) AS dm,
    CAST(ROUND(c * CAST(0.40 AS DOUBLE) + s * CAST(0.30 AS DOUBLE) + b * CAST(0.30 AS DOUBLE)) AS INT) AS sales,
    CAST(ROUND(s * CAST(0.30 AS DOUBLE) + e * CAST(0.40 AS DOUBLE) + i * CAST(0.15 AS DOUBLE) + c * CAST(0.15 AS DOUBLE)) AS INT) AS net,
    CAST(ROUND(s * CAST(0.25 AS DOUBLE) + i * CAST(0.25 AS DOUBLE) + c * CAST(0.25 AS DOUBLE) + e * CAST(0.25 AS DOUBLE)) AS INT) AS partnership
  FROM (SELECT seq, {_SENIOR} AS s, {_INDUSTRY} AS i, {_STAGE} AS c, {_EVENT} AS e, {_BUY} AS b FROM {{lead_rows}}) p) q"""
add("D04_composite_lead_scores", "lead_rows", _SCORES.replace("ROUND(", "bround("), re.sub(r"ROUND\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"round_even(\1, 0)", _SCORES))
add("O05_priority_sort", "lead_rows", f"SELECT seq, {_SENIOR} + {_INDUSTRY} AS score FROM {{lead_rows}} ORDER BY score DESC, seq LIMIT 10")
add("D22_retry_delay", "events", """
  SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 1440 ELSE CAST(least(120, power(2, least(event_id % 12, 7))) AS INT) END AS minutes FROM {events}""")
add("D23_stale", "events", "SELECT event_id, event_type IN ('click', 'view') AND ts < TIMESTAMP '2024-01-10 00:00:00' AS stale FROM {events}")
add("D24_retention", "events", "SELECT event_type, count(*) AS kept FROM {events} WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY event_type")
add("M08_campaign_history", "recipients", """
  SELECT id, email, CASE WHEN status IN ('UNSUBSCRIBED', 'BOUNCED') THEN 'Do not contact' ELSE 'Contacted' END AS status FROM {recipients}
  WHERE status NOT IN ('DRAFT', 'QUEUED', 'CANCELLED', 'SKIPPED_SUPPRESSED')""")
add("P18_grid_filter", "history_contacts", """
  SELECT seq FROM {history_contacts} WHERE status IN ('Contacted', 'Interested') AND contains(lower(full_name || chr(1) || company || chr(1) || owner), 'ring')""")
add("R01_ingest_events", "distinct_events", "SELECT id, provider_event_id FROM {distinct_events}")
add("R03_suppression_batch", "distinct_events", "SELECT recipient_id, min(occurred_at) AS since FROM {distinct_events} WHERE event_type = 'BOUNCED' GROUP BY recipient_id")
add("K01_chunked_terms", "part", """
  SELECT p_brand, chunk, count(*) AS terms, min(p_name) AS first_term FROM (SELECT p_brand, p_name,
    CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_name) - 1) / CAST(4 AS DOUBLE)) AS BIGINT) AS chunk
    FROM (SELECT DISTINCT p_brand, p_name FROM {part}) d) c GROUP BY p_brand, chunk""")


add("K05_task_table", "lead_rows region", """
  SELECT c.industry, s.seniority, r.r_name AS location, v.pass FROM (SELECT DISTINCT industry FROM {lead_rows}) c
  CROSS JOIN (SELECT DISTINCT seniority FROM {lead_rows}) s CROSS JOIN {region} r CROSS JOIN (SELECT 1 AS pass UNION ALL SELECT 2 UNION ALL SELECT 3) v""")
add("C05_select_visible", "lead_rows", "SELECT name, country, seniority, industry FROM {lead_rows}")


def _frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ADAPTERS:
        return frame(spark, sf_dir, name)
    if name in DERIVED:
        needs, query = DERIVED[name]
        return spark.sql(query, **{n: _frame(spark, sf_dir, n) for n in needs})
    return table(spark, sf_dir, name)


def _query(sources: tuple[str, ...], text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(text, **{n: _frame(spark, sf_dir, n) for n in sources})


def _twin(sources: tuple[str, ...], text: str) -> str:
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        if name in parts:
            return
        if name in ADAPTERS:
            tables, query = ADAPTERS[name]
            parts[name] = query.format(**{t: t for t in tables})
        elif name in DERIVED:
            for n in DERIVED[name][0]:
                need(n)
            parts[name] = DERIVED[name][1].format(**{n: n for n in DERIVED[name][0]})

    for s in sources:
        need(s)
    head = "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts.items()) + "\n" if parts else ""
    return head + text.format(**{s: s for s in sources})


QUERIES = {name: _query(sources, text) for name, (sources, text, _) in ENTRIES.items()}
ORACLES = {name: _twin(sources, twin or text) for name, (sources, text, twin) in ENTRIES.items()}
