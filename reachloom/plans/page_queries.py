"""Queries over pages and send slots, and their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as X
from ..operators import people as P
from ..operators import scheduling as S
from ..session import table
from .adapters import cte, frame


def x00(spark, sf_dir):
    return X.html_nodes(table(spark, sf_dir, "pages")).where("tag NOT LIKE '#%'").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


def _with_contacts(spark, sf_dir):
    """The pages, each with a contact block of its own, as the given ones have none."""
    n = F.lpad(F.col("page_id").cast("string"), 6, "0")
    block = F.concat(
        F.lit('<address>Ann Lee, press office <a href="tel:+44 20 7'), n, F.lit('">call</a></address><p>Phone: 080 1'), n, F.lit("7, 080 8"), n,
        F.lit('5 (switchboard)</p><a href="/about/team-'), n, F.lit('?x=1#y">Team</a><a href="/login/contact">no</a>'))
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), block))


def x12(spark, sf_dir):
    return X.phones_from_pages(_with_contacts(spark, sf_dir), "Ann Lee").drop("evidence")


def x13_links(spark, sf_dir):
    return X.page_links(table(spark, sf_dir, "pages")).select("page_id", "link")


def x13(spark, sf_dir):
    return X.relevant_links(_with_contacts(spark, sf_dir))


def x19(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(F.regexp_replace(X.plain_text(F.col("html")), r"\s+", "")).alias("letters"))


def x18(spark, sf_dir):
    rows = frame(spark, sf_dir, "search_rows").select("seq", F.concat(F.lit('<p><a href="'), "href", F.lit('">x</a> <a href="mailto:a@example.com">y</a></p>')).alias("html"))
    return X.message_links(rows, "seq", "html")


def d20(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.align_to_window(F.col("ts"), "Asia/Kolkata", (0, 1, 2, 3, 4), 9, 18).alias("at"))


QUERIES = {
    "X00_html_nodes": x00, "X12_phones_from_pages": x12, "X13_page_links": x13_links, "X13_relevant_links": x13, "X18_message_links": x18,
    "X19_plain_text": x19, "D20_align_to_window": d20,
}

_LOCAL = "ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Kolkata'"
ORACLES = {
    "X12_phones_from_pages": """
      WITH p AS (SELECT page_id, lpad(CAST(page_id AS VARCHAR), 6, '0') AS n FROM pages)
      SELECT page_id, '+44207' || n AS phone, 'business_phone' AS kind, 'leader_context' AS attribution, 'high' AS confidence FROM p
      UNION ALL SELECT page_id, '0801' || n || '7', 'business_phone', 'leader_context', 'medium' FROM p
      UNION ALL SELECT page_id, '0808' || n || '5', 'business_phone', 'leader_context', 'medium' FROM p""",
    "X13_relevant_links": """
      SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/about/team-' || lpad(CAST(page_id AS VARCHAR), 6, '0') AS link FROM pages""",
    "X18_message_links": cte("search_rows") + """
      SELECT seq, 0 AS pos, href AS destination_url, sha256(CAST(seq AS VARCHAR) || '|0|' || href) AS token FROM search_rows""",
    "D20_align_to_window": f"""
      WITH l AS (SELECT event_id, {_LOCAL} AS t, (dayofweek({_LOCAL}) + 6) % 7 AS w, hour({_LOCAL}) AS h FROM events)
      SELECT event_id, (CASE WHEN w < 5 AND h >= 9 AND h < 18 THEN t WHEN w < 5 AND h < 9 THEN date_trunc('day', t) + INTERVAL 9 HOUR
        ELSE date_trunc('day', t) + INTERVAL 9 HOUR + CASE WHEN w < 4 OR w = 6 THEN INTERVAL 1 DAY WHEN w = 4 THEN INTERVAL 3 DAY
        ELSE INTERVAL 2 DAY END END) AT TIME ZONE 'Asia/Kolkata' AT TIME ZONE 'UTC' AS at FROM l""",
}


def _with_people(spark, sf_dir):
    """The pages, each with people of its own in a data set, linked data and a link, as the given ones have none."""
    name = F.concat(F.lit("Ann "), F.initcap(F.translate(F.col("page_id").cast("string"), "0123456789", "abcdefghij")))
    n = F.col("page_id").cast("string")
    block = F.concat(
        F.lit('<script>var d = {"speakers": [{"fullName": "'), name, F.lit('", "jobTitle": "CTO", "company": {"name": "Acme"}, "linkedin": "https://in.linkedin.com/in/Ann-'), n,
        F.lit('"}, {"name": "Bob Ray", "status": "draft"}]}</script><script type="application/ld+json">{"@type": "Person", "name": "Kim Poe", "sameAs": "https://linkedin.com/in/kim-'), n,
        F.lit('"}</script><p><a href="https://www.linkedin.com/in/ann-'), n, F.lit('/">Ann X VP at Beta</a></p>'))
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), block))


def x06_raw(spark, sf_dir):
    return P.raw_people(_with_people(spark, sf_dir)).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


def x10(spark, sf_dir):
    return P.person_records(P.raw_people(_with_people(spark, sf_dir))).select("page_id", "dataset", "name", "designation", "company", "profile_url", "match_status")


def x11(spark, sf_dir):
    return P.extract_people(_with_people(spark, sf_dir))[0].select("page_id", "name", "designation", "company", "profile_url")


_NAME = "'Ann ' || upper(substr(a, 1, 1)) || substr(a, 2)"
_PEOPLE = "p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS n, translate(CAST(page_id AS VARCHAR), '0123456789', 'abcdefghij') AS a FROM pages)"
QUERIES |= {"X06_raw_people": x06_raw, "X10_person_records": x10, "X11_extract_people": x11}
ORACLES |= {
    "X06_raw_people": """SELECT d AS dataset, CAST(count(*) * k AS BIGINT) AS n, count(*) AS pages FROM pages CROSS JOIN (VALUES ('speakers', 2), ('json_ld_person', 1), ('visible_profile_links', 1)) t(d, k) GROUP BY d, k""",
    "X10_person_records": f"""WITH {_PEOPLE}
      SELECT page_id, 'speakers' AS dataset, {_NAME} AS name, 'CTO' AS designation, 'Acme' AS company, 'https://www.linkedin.com/in/ann-' || n || '/' AS profile_url, 'provided' AS match_status FROM p
      UNION ALL SELECT page_id, 'json_ld_person', 'Kim Poe', '', 'Unknown', 'https://www.linkedin.com/in/kim-' || n || '/', 'provided' FROM p
      UNION ALL SELECT page_id, 'visible_profile_links', 'Ann X', 'VP', 'Beta', 'https://www.linkedin.com/in/ann-' || n || '/', 'provided' FROM p""",
    "X11_extract_people": f"""WITH {_PEOPLE}
      SELECT page_id, {_NAME} AS name, 'CTO' AS designation, 'Acme' AS company, 'https://www.linkedin.com/in/ann-' || n || '/' AS profile_url FROM p
      UNION ALL SELECT page_id, 'Kim Poe', '', 'Unknown', 'https://www.linkedin.com/in/kim-' || n || '/' FROM p""",
}
