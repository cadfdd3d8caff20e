"""Contact, message and page tables derived from the given tables, as SQL that any engine reads alike.

The given tables hold no contacts; these projections make contact-shaped rows whose number follows the input. Each text
is used twice: by Spark as a query over DataFrames, and by the SQL twins as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import table

NAME = "p_name || ' ' || translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij')"
PERSON = "p_name || ' ' || translate(CAST(o_custkey AS STRING), '0123456789', 'abcdefghij')"

#: Name -> (tables it reads, query).
ADAPTERS: dict[str, tuple[tuple[str, ...], str]] = {
    "primary_contacts": (
        ("customer", "part"),
        f"""
        SELECT c_custkey AS seq, 'primary' AS source_id,
          CASE WHEN c_custkey % 97 = 5 THEN '' ELSE {NAME} END AS full_name,
          p_brand || CASE c_custkey % 3 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' Limited' ELSE '' END AS company,
          CASE c_custkey % 6 WHEN 0 THEN 'Chief Marketing Officer' WHEN 1 THEN 'VP Engineering'
            WHEN 2 THEN 'Senior Director of Sales' WHEN 3 THEN 'Consultant' WHEN 4 THEN 'Head of Data'
            ELSE 'Hiring managers' END AS designation,
          CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'broken@@example'
            ELSE 'U' || CAST(c_custkey - (c_custkey % 29) % 2 AS STRING) || '@Example.com' END AS email,
          CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN '12-34'
            ELSE '+91 9' || lpad(CAST((c_custkey * 7919) % 1000000000 AS STRING), 9, '0') END AS phone,
          CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN 'https://www.linkedin.com/company/x'
            ELSE 'linkedin.com/in/Person-' || CAST(c_custkey AS STRING) || '?trk=a' END AS profile_url,
          '' AS status, c_mktsegment AS notes
        FROM (SELECT *, c_custkey % (SELECT count(*) FROM {{part}}) AS part_no FROM {{customer}}) c JOIN {{part}} ON p_partkey = part_no""",
    ),
    "history_contacts": (
        ("orders", "part"),
        f"""
        SELECT o_orderkey AS seq, 'history' || CAST(o_orderkey % 2 AS STRING) AS source_id,
          CASE o_orderkey % 4 WHEN 1 THEN upper({PERSON})
            WHEN 2 THEN replace({PERSON}, 'id', 'di') ELSE {PERSON} END AS full_name,
          p_brand || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' LLP' ELSE ' Ltd' END AS company,
          CASE WHEN o_orderkey % 3 = 0 THEN 'u' || CAST(o_custkey AS STRING) || '@example.com' ELSE '' END AS email,
          CASE WHEN o_orderkey % 5 = 0
            THEN '9' || lpad(CAST((o_custkey * 7919) % 1000000000 AS STRING), 9, '0') ELSE '' END AS phone,
          CASE WHEN o_orderkey % 8 = 0 THEN 'https://in.linkedin.com/in/person-' || CAST(o_custkey AS STRING) || '/'
            ELSE '' END AS profile_url,
          CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'Contacted'
            WHEN o_orderstatus = 'O' THEN 'Interested' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Do not contact'
            ELSE 'Safe to recontact' END END AS status,
          o_orderpriority AS owner, CAST(CAST(o_orderdate AS DATE) AS STRING) AS contact_date
        FROM (SELECT *, o_custkey % (SELECT count(*) FROM {{part}}) AS part_no FROM {{orders}}) o JOIN {{part}} ON p_partkey = part_no""",
    ),
    "message_events": (
        ("events",),
        """
        SELECT event_id AS id, user_id AS recipient_id, user_id % 7 AS campaign_id,
          CASE event_type WHEN 'signup' THEN 'SENT' WHEN 'view' THEN 'OPENED' WHEN 'click' THEN 'CLICKED'
            WHEN 'purchase' THEN 'REPLIED' ELSE 'BOUNCED' END AS event_type,
          ts AS occurred_at, 'p' || CAST(event_id - event_id % 2 * (event_id % 5 // 4) AS STRING) AS provider_event_id
        FROM {events}""",
    ),
    "recipients": (
        ("customer",),
        """
        SELECT c_custkey AS id, c_custkey % 7 AS campaign_id,
          CASE WHEN c_custkey % 31 = 0 THEN 'not an address' ELSE 'r' || CAST(c_custkey % 900 AS STRING) || '@example.com' END AS email,
          CASE c_custkey % 9 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'SENT' WHEN 3 THEN 'OPENED'
            WHEN 4 THEN 'CLICKED' WHEN 5 THEN 'REPLIED' WHEN 6 THEN 'BOUNCED' WHEN 7 THEN 'UNSUBSCRIBED'
            ELSE 'CANCELLED' END AS status,
          CASE WHEN c_custkey % 10 = 3 THEN 'RECONTACT_ALLOWED' ELSE '' END AS response_classification,
          CASE WHEN c_nationkey % 4 = 0 THEN 'SAFE TO CONTACT' WHEN c_nationkey % 4 = 1 THEN 'safe to contact'
            ELSE 'REVIEW' END AS decision,
          c_name AS full_name, c_mktsegment AS company, c_acctbal AS balance, c_custkey % 50 AS minute
        FROM {customer}""",
    ),
    "search_rows": (
        ("documents",),
        """
        SELECT doc_id AS seq, doc_id // 20 AS page, doc_id % 20 AS pos,
          translate(CAST(doc_id % 400 AS STRING), '0123456789', 'abcdefghij') || ' ' || split_part(text, ' ', 1)
            || CASE doc_id % 4 WHEN 0 THEN ' - VP Sales at ' WHEN 1 THEN ' - Director @ ' WHEN 2 THEN ' | ' ELSE ' - ' END
            || source || ' Group' AS title,
          text AS body,
          CASE WHEN doc_id % 13 = 0 THEN 'https://example.org/p' || CAST(doc_id AS STRING)
            ELSE 'https://www.linkedin.com/in/Person-' || CAST(doc_id % 400 AS STRING) || '/?x=1' END AS href,
          CASE WHEN doc_id % 3 = 0 THEN 'google_web' WHEN doc_id % 3 = 1 THEN 'Google' ELSE 'other' END AS source,
          lang AS query
        FROM {documents}""",
    ),
    "lead_rows": (
        ("supplier", "nation"),
        """
        SELECT s_suppkey AS seq, s_name AS name, n_name AS country,
          CASE s_suppkey % 6 WHEN 0 THEN 'CEO' WHEN 1 THEN 'CTO' WHEN 2 THEN 'VP' WHEN 3 THEN 'Director'
            WHEN 4 THEN 'Managing Director' ELSE 'Intern' END AS seniority,
          CASE s_suppkey % 5 WHEN 0 THEN 'FinTech' WHEN 1 THEN 'SaaS' WHEN 2 THEN 'Retail' WHEN 3 THEN 'Energy'
            ELSE 'Farming' END AS industry,
          CASE s_suppkey % 4 WHEN 0 THEN 'Unicorn (>$1B)' WHEN 1 THEN 'Mid-Market (500-5K)'
            WHEN 2 THEN 'Early Stage (<100)' ELSE 'Unknown' END AS company_stage,
          CASE WHEN s_suppkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS speaker,
          CASE WHEN s_suppkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS podcast,
          CASE WHEN s_suppkey % 7 = 0 THEN 'Best' WHEN s_suppkey % 7 = 1 THEN '' ELSE 'None' END AS awards,
          CASE WHEN s_suppkey % 4 = 0 THEN 'Series A' WHEN s_suppkey % 4 = 1 THEN 'Bootstrapped' ELSE '' END AS funding,
          CASE s_suppkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS ai_signals
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    ),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's rows, lazily."""
    tables, query = ADAPTERS[name]
    query = re.sub(r"(\S+ % \d+|\S+) // (\d+)", r"\1 DIV \2", query)
    return spark.sql(query, **{t: table(spark, sf_dir, t) for t in tables})


def cte(*names: str) -> str:
    """WITH clause that gives the twins the same rows."""
    parts = [f"{n} AS ({ADAPTERS[n][1].format(**{t: t for t in ADAPTERS[n][0]})})" for n in names]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
