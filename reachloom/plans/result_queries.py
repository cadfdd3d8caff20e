"""Queries over search results, profiles and people on pages, slots, combinations and stores, and their twins.

The given tables hold no profiles: each row gets fields of its own, said in one of several forms and at a place of its own
in its text; the twins return the fields, by the form.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attendees as A
from ..operators import candidates as C
from ..operators import ordering as O
from ..operators import pages as X
from ..operators import people as P
from ..operators import profiles as L
from ..operators import results as R
from ..operators import scheduling as S
from ..session import table
from ..sources import store as T
from ..streaming.events import LiveFunnel
from ..storage import saved, scratch_dir
from .adapters import cte, frame
from .table_queries import _frame, _twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(made):
        QUERIES[name] = made
        if sql:
            ORACLES[name] = sql
        return made

    return register


_LETTERS = "translate(CAST({0} AS STRING), '0123456789', 'abcdefghij')"
_NAME = f"'Ann X' || {_LETTERS.format('doc_id')} || 'z'"
_ROLE = "CASE doc_id % 4 WHEN 0 THEN 'Chief Data Officer' WHEN 1 THEN 'Head of Sales' WHEN 2 THEN 'VP Engineering' ELSE 'Director of Ops' END"
_COMPANY = f"'Acme ' || {_LETTERS.format('(doc_id % 97)')}"
#: Fields of each document, in SQL that reads alike in both engines.
_FIELDS = f"SELECT doc_id, coalesce(text, '') AS text, source, lang, (doc_id * 7) % 200 AS cut, {_NAME} AS n, {_ROLE} AS r, {_COMPANY} AS c FROM documents"
_HEADLINES = f"""SELECT doc_id AS seq, n, r, c, source, lang AS query, text,
  CASE doc_id % 9 WHEN 0 THEN n || ' - ' || r || ' at ' || c WHEN 1 THEN n || ' — ' || r || ' @' || c || ', Ex ...' WHEN 2 THEN n || ' - ' || r || ' - ' || c || ' | LinkedIn'
    WHEN 3 THEN n || ' | LinkedIn' WHEN 4 THEN n || ' | ' || r || ' | ' || c WHEN 5 THEN n || ' - ' || r WHEN 6 THEN n WHEN 7 THEN n || ' – Intern – Beta' ELSE '' END AS title,
  substr(text, 1, cut) || CASE doc_id % 9 WHEN 3 THEN ' · Current: ' || r || ' at ' || c || ' · ' WHEN 5 THEN ' · Experience: ' || c || ' · ' WHEN 6 THEN ' · Title: ' || r || ' · Company: ' || c || ' · '
    WHEN 7 THEN ' · Currently working as ' || r || ' at ' || c || ' | ' ELSE ' · ' END || substr(text, cut + 1) AS body FROM ({_FIELDS}) f"""


def _headlines(spark, sf_dir):
    return spark.sql(_HEADLINES.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


@query("X01_parse_profile_fields", f"""SELECT seq, CASE WHEN seq % 9 = 8 THEN 'Unknown' ELSE n END AS name, CASE WHEN seq % 9 = 8 THEN '' ELSE r END AS designation,
  CASE WHEN seq % 9 = 8 THEN 'Unknown' ELSE c END AS company FROM ({_HEADLINES.replace('AS STRING', 'AS VARCHAR')}) h""")
def x01(spark, sf_dir):
    return _headlines(spark, sf_dir).select("seq", R.parse_profile_fields(F.col("title"), F.col("body")).alias("f")).select("seq", "f.*")


@query("X03_candidates_from_results", f"""WITH h AS ({_HEADLINES.replace('AS STRING', 'AS VARCHAR')})
  SELECT 'https://www.linkedin.com/in/own-' || CAST(seq AS VARCHAR) || '/' AS url, CASE WHEN seq % 9 IN (6, 8) THEN CASE WHEN seq % 9 = 6 THEN n ELSE 'Unknown' END ELSE n END AS name,
    source, query FROM h WHERE seq % 5 <> 2
  UNION ALL SELECT 'https://www.linkedin.com/in/one-' || CAST(seq AS VARCHAR) || '/', 'Bo "R" ' || c, source, query FROM h WHERE seq % 3 = 0
  UNION ALL SELECT 'https://www.linkedin.com/in/two-' || CAST(seq AS VARCHAR) || '/', n, source, query FROM h WHERE seq % 3 = 0""")
def x03(spark, sf_dir):
    record = F.expr("""'\\n"https://www.linkedin.com/in/One-' || seq || '/": {\\n "body": "Location: Oslo.",\\n "company": "' || c || '",\\n "designation": "CTO",\\n "name": "Bo \\\\"R\\\\" ' || c || '"\\n},
 "https://linkedin.com/in/two-' || seq || '?x": {\\n "title": "' || n || ' - CTO"\\n}\\n'""")
    rows = _headlines(spark, sf_dir).withColumn("body", F.concat("body", F.when(F.col("seq") % 3 == 0, record).otherwise(F.lit(""))))
    href = F.when(F.col("seq") % 5 == 2, "https://example.org").otherwise(F.concat(F.lit("https://no.linkedin.com/in/Own-"), F.col("seq").cast("string")))
    found = R.candidates_from_results(rows.select("seq", "title", "body", href.alias("href"), "source", "query"))
    return found.select("url", "name", F.col("sources")[0].alias("source"), "query")


_STRICT = f"""SELECT doc_id AS seq, n, r, c, doc_id % 8 AS k, text,
  CASE doc_id % 8 WHEN 0 THEN n || ' - ' || r || ' at ' || c || ' | LinkedIn' WHEN 1 THEN n || ' - ' || r || ' - ' || c || ' | LinkedIn' WHEN 2 THEN n || ' - Oslo, Viken, India | Professional Profile'
    WHEN 3 THEN n || ' | LinkedIn' WHEN 4 THEN n || ' - Data Leader | ' || r || ' at ' || c WHEN 5 THEN n || ' - ' || r || ' - Looking for ... | LinkedIn' WHEN 6 THEN n || ' | LinkedIn' ELSE n || ' - Beta' END AS title,
  CASE doc_id % 8 WHEN 3 THEN 'Current: ' || r || ' at ' || c || ' · Location: Oslo · ' WHEN 5 THEN 'Experience: ' || c || ' · Location: Oslo · 500+ connections on LinkedIn. · '
    WHEN 6 THEN 'Hiring a Director of Data at Gamma · ' WHEN 7 THEN 'Oslo, Viken · ' || r || ' · ' || c || ' Experience · ' ELSE 'x | ' END || text AS body FROM ({_FIELDS}) f"""


def _strict(spark, sf_dir):
    return spark.sql(_STRICT.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


@query("X02_parse_profile", f"""SELECT seq, n AS name, CASE WHEN k IN (2, 6) THEN '' ELSE r END AS designation, CASE WHEN k IN (2, 6) THEN 'Unknown' ELSE c END AS company
  FROM ({_STRICT.replace('AS STRING', 'AS VARCHAR')}) s""")
def x02(spark, sf_dir):
    rows = _strict(spark, sf_dir).select("seq", "title", "body", F.concat(F.lit("linkedin.com/in/p"), F.col("seq").cast("string")).alias("href"))
    return L.parse_profiles(rows).select("seq", "name", "designation", "company")


@query("P08_profile_location", f"""SELECT seq, CASE k WHEN 2 THEN 'Oslo, Viken, India' WHEN 3 THEN 'Oslo' WHEN 5 THEN 'Oslo' WHEN 7 THEN 'Oslo, Viken' ELSE '' END AS place
  FROM ({_STRICT.replace('AS STRING', 'AS VARCHAR')}) s""")
def p08(spark, sf_dir):
    return _strict(spark, sf_dir).select("seq", L.profile_location(F.col("body"), F.col("title"), ["Oslo", "NCR"], strict=True, name=F.col("n")).alias("place"))


# --- pages ------------------------------------------------------------------------------------------------------------
def _with(spark, sf_dir, block: str) -> DataFrame:
    """The pages with a block of their own at the end."""
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.expr(block)))


@query("X04_results_from_html", """WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS n, CAST(page_id % 4 AS BIGINT) AS cards FROM pages)
  SELECT page_id, CAST(k AS INTEGER) AS rank, 'https://www.linkedin.com/in/p' || n || '-' || CAST(k AS VARCHAR) || '/' AS url, 'Ann ' || CAST(k AS VARCHAR) || ' - CTO' AS title,
    'Ann ' || CAST(k AS VARCHAR) || ' - CTO' || CASE WHEN k = cards THEN ' again' ELSE '' END || ' Town ' || n AS body FROM p, range(1, 4) t(k) WHERE k <= cards
  UNION ALL SELECT page_id, 1, 'https://www.linkedin.com/in/bare' || n || '/', 'Bare', 'Bare' FROM p WHERE cards = 0""")
def x04(spark, sf_dir):
    card = """CASE WHEN page_id % 4 >= {k} THEN '<li class="b_algo x"><a href="' || CASE WHEN page_id % 2 = 0 THEN 'https://no.linkedin.com/in/P' || page_id || '-{k}?t=1' ELSE
      'https://find.example/l/?uddg=https%3A%2F%2Flinkedin.com%2Fin%2Fp' || page_id || '-{k}%2F' END || '">Ann <b>{k}</b> - CTO</a>' || CASE WHEN page_id % 4 = {k} THEN
      '<a href="https://www.linkedin.com/in/p' || page_id || '-1/">again</a>' ELSE '' END || '<p>Town ' || page_id || '</p></li>' ELSE '' END"""
    block = "'</ul></div>' || " + " || ".join(card.format(k=k) for k in (1, 2, 3)) + """ || CASE WHEN page_id % 4 = 0 THEN '<p><a href="https://linkedin.com/in/bare' || page_id || '">Bare</a></p>' ELSE '' END"""
    nodes = saved(X.html_nodes(_with(spark, sf_dir, block)), "nodes")
    return R.results_from_html(nodes, (("li", "b_algo", ""),), 3).select("page_id", "rank", "url", "title", "body")


_LINK = "'https://www.linkedin.com/in/q' || page_id"


@query("X08_profile_links", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Ann Marie Lee' ELSE 'Ann Lee' END AS name,
  CASE page_id % 5 WHEN 0 THEN 'of sales' WHEN 1 THEN 'CTO' WHEN 2 THEN 'Head of Data' WHEN 3 THEN 'VP Sales' ELSE '' END AS designation,
  CASE page_id % 5 WHEN 4 THEN 'Unknown' ELSE 'Beta ' || CAST(page_id AS VARCHAR) END AS company FROM pages""")
def x08(spark, sf_dir):
    block = f"""'</div>' || CASE page_id % 5 WHEN 0 THEN '<a href="' || {_LINK} || '">Ann Marie Lee of sales at Beta ' || page_id || '</a>'
      WHEN 1 THEN '<a href="' || {_LINK} || '">Ann Lee · CTO at Beta ' || page_id || '</a><a href="' || {_LINK} || '/">Other Name</a>'
      WHEN 2 THEN '<div><h3>Old Name</h3><h3>Ann Lee</h3><p>Current: Head of Data at Beta ' || page_id || '</p><a href="' || {_LINK} || '">LinkedIn</a></div>'
      WHEN 3 THEN '<section><h3>Ann Lee - VP Sales - Beta ' || page_id || '</h3><p><a href="' || {_LINK} || '">LinkedIn</a></p></section>'
      ELSE '<div class="team-box"><span class="full-name">Ann Lee</span><i><a href="' || {_LINK} || '"><img src="x"></a></i></div>' END"""
    nodes = saved(X.html_nodes(_with(spark, sf_dir, block)), "nodes")
    return P.profile_links(nodes).select("page_id", "name", "designation", "company")


@query("X09_people_from_cards", """SELECT page_id, CASE WHEN page_id % 4 < 2 THEN 'overlay' ELSE 'card' END AS kind, 'Ann Lee' AS name,
  CASE page_id % 4 WHEN 3 THEN '' ELSE 'CTO' END AS designation, CASE page_id % 4 WHEN 3 THEN 'Unknown' ELSE 'Beta ' || CAST(page_id AS VARCHAR) END AS company FROM pages""")
def x09(spark, sf_dir):
    block = """'</div>' || CASE page_id % 4 WHEN 0 THEN '<div class="a-speaker-box"><h3>Ann Lee</h3><h4>CTO at Beta ' || page_id || '</h4></div><div class="speaker-item"><h3>Room 1</h3></div>'
      WHEN 1 THEN '<p class="speaker-overlay"><strong>Ann Lee</strong><strong>CTO</strong><strong>Beta ' || page_id || '</strong></p>'
      WHEN 2 THEN '<li class="panelist x"><h4>Ann Lee</h4><p>Current: CTO at Beta ' || page_id || '</p></li><li class="panelist"><h4>Ann Lee</h4></li>'
      ELSE '<article class="lineup"><h2>Ann Lee</h2><h3>no field</h3></article>' END"""
    nodes = saved(X.html_nodes(_with(spark, sf_dir, block)), "nodes")
    overlay = P.overlay_cards(nodes).withColumn("kind", F.lit("overlay"))
    cards = P.person_cards(nodes).withColumn("kind", F.lit("card")).join(overlay.select("page_id"), "page_id", "left_anti")
    return overlay.unionByName(cards.select(*overlay.columns)).select("page_id", "kind", "name", "designation", "company")


@query("X11_clashing_records", """WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS n, page_id % 4 AS k FROM pages)
  SELECT page_id, CASE k WHEN 2 THEN 'Ann Lee' WHEN 3 THEN 'Ann Lee' ELSE 'Ann Marie Lee' END AS name, CASE k WHEN 2 THEN 'CTO' WHEN 3 THEN '' ELSE '' END AS designation FROM p
  UNION ALL SELECT page_id, 'Cy Fox', '' FROM p""")
def x11(spark, sf_dir):
    # the same id, the same name and company, the same profile and fuller, the same profile and fewer words in the name
    other = """CASE page_id % 4 WHEN 0 THEN '{"id": 7, "name": "Bo Ray", "jobTitle": "CTO"}' WHEN 1 THEN '{"id": 9, "name": "ann  marie lee", "jobTitle": "CTO"}'
      WHEN 2 THEN '{"id": 9, "name": "Ann Lee", "jobTitle": "CTO", "linkedin": "https://linkedin.com/in/a' || page_id || '"}'
      ELSE '{"id": 9, "name": "Ann Lee", "linkedin": "https://no.linkedin.com/in/A' || page_id || '?x"}' END"""
    block = f"""'<script>x = {{"speakers": [{{"id": 7, "name": "Ann Marie Lee", "linkedin": "https://linkedin.com/in/a' || page_id || '"}}, ' || {other} || ', {{"id": 9, "name": "Cy Fox"}}]}}</script>'"""
    return P.extract_people(_with(spark, sf_dir, block))[0].select("page_id", "name", "designation")


# --- slots, combinations, stores --------------------------------------------------------------------------------------
@query("D21_send_slots", cte("recipients") + """,
  g AS (SELECT id, campaign_id, row_number() OVER (PARTITION BY campaign_id ORDER BY id) - 1 AS n FROM recipients),
  d AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE 10 + CAST('0x' || substr(md5(CAST(campaign_id AS VARCHAR) || '|' || CAST(n AS VARCHAR)), 1, 8) AS BIGINT) % 21 END AS gap FROM g),
  s AS (SELECT campaign_id, n, id, TIMESTAMP '2024-03-01 10:30:00' AS wh, 1 AS sent FROM d WHERE n = 0
    UNION ALL SELECT campaign_id, n, id, CASE WHEN fits THEN t ELSE date_trunc('day', wh) + to_hours(9) + to_days(CASE WHEN isodow(wh) >= 5 THEN 8 - isodow(wh) ELSE 1 END) END,
      CASE WHEN fits THEN sent + 1 ELSE 1 END FROM (SELECT d.campaign_id, d.n, d.id, s.wh, s.sent, s.wh + to_minutes(d.gap) AS t,
        s.sent < 27 AND s.wh + to_minutes(d.gap) < date_trunc('day', s.wh) + to_hours(18) AS fits FROM s JOIN d ON d.campaign_id = s.campaign_id AND d.n = s.n + 1) x)
  SELECT id, campaign_id, wh AS send_at FROM s""")
def d21(spark, sf_dir):
    return S.send_slots(frame(spark, sf_dir, "recipients"), datetime.datetime(2024, 3, 1, 10, 30), "UTC", (0, 1, 2, 3, 4), 9, 18, 10, 30, 27)


@query("K02_coverage_combinations", _twin(("region", "nation", "lead_rows"), """, x AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS i FROM region),
  y AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS j FROM nation), z AS (SELECT seniority, row_number() OVER (ORDER BY seniority) - 1 AS k FROM (SELECT DISTINCT seniority FROM lead_rows) s)
  SELECT r_name, n_name, seniority, row_number() OVER (ORDER BY CASE WHEN i = j % (SELECT count(*) FROM x) AND k = j % (SELECT count(*) FROM z) THEN 0 ELSE 1 END,
    CASE WHEN i = j % (SELECT count(*) FROM x) AND k = j % (SELECT count(*) FROM z) THEN j ELSE i + j + k END, greatest(i, j, k), i, j, k) AS place FROM x CROSS JOIN y CROSS JOIN z""").replace(")\n, x AS", "),\nx AS"))
def k02(spark, sf_dir):
    levels = frame(spark, sf_dir, "lead_rows").select("seniority").distinct()
    return O.combinations([table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name"), levels])


def _stored(made: Callable[..., T.Store], spark: SparkSession, name: str, parts: list[DataFrame]) -> T.Store:
    """A store of its own that has taken the parts one by one, the last one twice."""
    store = made(spark, f"{scratch_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{datetime.datetime.now().timestamp()}", 8)
    for number, part in enumerate([*parts, parts[-1]]):
        store.upsert(part, min(number, len(parts) - 1))
    return store


@query("A11_lead_upsert", _twin(("candidates",), "SELECT url, min(seq) AS first_seen, max(seq) AS last_seen, arg_max(name, seq) AS name, arg_max(company, seq) AS company FROM candidates WHERE url <> '' GROUP BY url"))
def a11(spark, sf_dir):
    rows = _frame(spark, sf_dir, "candidates").where("url != ''").select(
        "url", F.col("seq").alias("first_seen"), F.col("seq").alias("last_seen"), "name", "designation", "company")
    store = _stored(T.lead_store, spark, "leads", [rows.where("first_seen % 5 < 3"), rows.where("first_seen % 5 >= 3")])
    return store.read().select("url", "first_seen", "last_seen", "name", "company")


@query("A10_metric_upsert", cte("message_events") + "SELECT CAST(campaign_id AS VARCHAR) AS job, event_type AS name, count(*) AS added, max({'t': occurred_at, 'i': id}).i AS value FROM message_events GROUP BY ALL")
def a10(spark, sf_dir):
    rows = frame(spark, sf_dir, "message_events").select(
        F.col("campaign_id").cast("string").alias("job"), F.col("event_type").alias("name"), F.lit(1).cast("bigint").alias("added"), F.col("id").alias("value"),
        F.col("occurred_at").alias("at"))
    return _stored(T.metric_store, spark, "metrics", [rows.where("value % 3 = 0"), rows.where("value % 3 > 0")]).read().select("job", "name", "added", "value")


@query("J17_evidence_upsert", _twin(("candidates",), "SELECT url, arg_max(title, seq) AS evidence, max(seq) AS created FROM candidates WHERE url <> '' GROUP BY url HAVING max(seq) % 7 = 0 OR max(seq) + 500 > 800"))
def j17(spark, sf_dir):
    rows = _frame(spark, sf_dir, "candidates").where("url != ''").select(
        F.lit("job").alias("job"), F.lit("page").alias("kind"), F.col("url").alias("key"), F.col("title").alias("evidence"),
        F.when(F.col("seq") % 7 > 0, F.col("seq") + 500).alias("expires"), F.col("seq").alias("created"))
    store = _stored(T.evidence_store, spark, "evidence", [rows.where("created % 2 = 0"), rows.where("created % 2 = 1")])
    return T.valid_evidence(store, F.lit(800)).select(F.col("key").alias("url"), "evidence", "created")


@query("A01_from_results")
def a01_from_results(spark, sf_dir):
    """X03 straight into A01."""
    rows = _headlines(spark, sf_dir).select("seq", "title", "body", F.concat(F.lit("linkedin.com/in/m"), (F.col("seq") % 400).cast("string")).alias("href"), "source", "query")
    return C.merge_candidates(R.candidates_from_results(rows)).select("url", "name", "designation", "company", F.size("sources").alias("sources"))


@query("R05_live_funnel", cte("message_events") + """, f AS (SELECT campaign_id, recipient_id, list_reduce(list_prepend('SENT', list(event_type ORDER BY occurred_at, id)), lambda s, t:
    CASE WHEN t IN ('REPLIED', 'BOUNCED', 'UNSUBSCRIBED') THEN t WHEN t = 'OPENED' AND s = 'SENT' THEN 'OPENED' WHEN t = 'CLICKED' AND s IN ('SENT', 'OPENED') THEN 'CLICKED' ELSE s END) AS status
    FROM message_events GROUP BY ALL)
  SELECT campaign_id, count(*) AS total, count(*) FILTER (WHERE status IN ('SENT', 'OPENED', 'CLICKED', 'REPLIED')) AS sent, count(*) FILTER (WHERE status IN ('OPENED', 'CLICKED', 'REPLIED')) AS opened,
    count(*) FILTER (WHERE status = 'CLICKED') AS clicked, count(*) FILTER (WHERE status = 'REPLIED') AS replied, count(*) FILTER (WHERE status = 'BOUNCED') AS bounced,
    count(*) FILTER (WHERE status = 'UNSUBSCRIBED') AS unsubscribed FROM f GROUP BY campaign_id""")
def r05(spark, sf_dir):
    rows = frame(spark, sf_dir, "message_events").select("id", "campaign_id", "recipient_id", "event_type", "occurred_at")
    live = LiveFunnel(spark, f"{scratch_dir(spark)}/funnel-{spark.sparkContext.applicationId}-{datetime.datetime.now().timestamp()}", 8)
    for number, part in enumerate((2, 0, 1)):  # not in the events' order, and the last one twice
        live.apply(rows.where(F.col("id") % 3 == part), number)
    live.apply(rows.where("id % 3 = 1"), 2)
    return live.read()


_POSTS = f"""SELECT doc_id AS post, doc_id % 5 AS source_no, source, substr(text, 1, cut) || '. Speakers include ' || n || ' at the summit. ' || substr(text, cut + 1) AS text FROM ({_FIELDS}) f"""


@query("D16_event_attendees", f"""WITH f AS ({_FIELDS.replace('AS STRING', 'AS VARCHAR')})
  SELECT 'https://www.linkedin.com/in/e' || CAST(doc_id AS VARCHAR) || '/' AS url, n AS name, r AS designation, CASE WHEN doc_id % 3 = 0 THEN 'Yes' ELSE 'Check' END AS place FROM f
  WHERE doc_id % 3 = 0 OR doc_id % 4 = 1""")
def d16(spark, sf_dir):
    fields = spark.sql(_FIELDS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    posts = spark.sql(_POSTS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    href = F.concat(F.lit("https://linkedin.com/in/e"), F.col("doc_id").cast("string"))
    seen = fields.select(F.col("doc_id").alias("profile"), F.expr("n || ' - ' || r || ' at ' || c || ' | LinkedIn'").alias("title"), href.alias("href"),
                         F.when(F.col("doc_id") % 3 == 0, "Location: Oslo · x").otherwise("x").alias("body"))
    direct = seen.limit(0).select(F.lit("").alias("source"), F.lit(0).cast("bigint").alias("source_no"), F.col("profile").alias("row"), "title", "href", "body")
    return A.event_attendees(posts, seen, direct, ["Head of Sales"], ["Oslo"]).select("url", "name", "designation", "place")
