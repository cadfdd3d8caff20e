"""Queries of the operators that take a request, a mapping or templates. The twins are written apart from them: they say
the same rules for these settings in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as X
from ..operators import campaigns as M
from ..operators import candidates as C
from ..operators import keys as K
from ..operators import ordering as R
from ..operators import schemas as S
from ..operators import scoring as L
from ..operators import signals as G
from ..session import table
from . import twins as T
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


def one_of(text: str, *terms: str) -> str:
    return "(" + " OR ".join(T.p01(text, t.lower()) for t in terms) + ")"


# --- roles and places -------------------------------------------------------------------------------------------------
ROLES = X.Taxonomy((
    X.Entry("CMO", ("Chief Marketing Officer",), "marketing", "executive"),
    X.Entry("VP Engineering", ("Vice President Engineering", "VP of Engineering"), "engineering", "vice_president"),
    X.Entry("VP Sales", ("Vice President Sales", "Head of Sales"), "sales", "vice_president"),
    X.Entry("VP", ("Vice President",), "generic_vp", "vice_president"),
    X.Entry("Head of Data", ("Data Head",), "data", "head"),
    X.Entry("Sales Director", ("Director of Sales",), "sales", "director"),
    X.Entry("Director", (), "generic_director", "director"),
    X.Entry("Senior Director", (), "generic_director", "director"),
    X.Entry("Regional Director", ("Area Director",), "generic_director", "director"),
    X.Entry("Chief of Staff", (), "marketing", "executive"),
), {"sales directr": "Sales Director"})
PLACES = X.Taxonomy((X.Entry("North", ("thre", "and the")), X.Entry("South", ("los", "le")), X.Entry("East", ("und",))))
_ASKED = ["CMO", "Chief of Staff", "VP", "Regional Director", "sales directr", "vp", "xyz", "Data", "Senior Director"]


@query("P03_role_match_strength", cte("primary_contacts") + f"""
  SELECT seq, CASE WHEN {one_of('designation', 'CMO', 'Chief Marketing Officer')} THEN 3 WHEN {one_of('designation', 'Chief of Staff')} THEN 2 ELSE 0 END AS r0,
    CASE WHEN {one_of('designation', 'Chief of Staff')} THEN 3 WHEN {one_of('designation', 'CMO', 'Chief Marketing Officer')} THEN 2 ELSE 0 END AS r1,
    CASE WHEN {one_of('designation', 'VP', 'Vice President')} THEN 3 WHEN {one_of('designation', 'Head of Sales')} THEN 2 ELSE 0 END AS r2,
    CASE WHEN {one_of('designation', 'Regional Director', 'Area Director')} THEN 3 WHEN {one_of('designation', 'Director')} THEN 2 ELSE 0 END AS r3,
    CASE WHEN {one_of('designation', 'Sales Director', 'Director of Sales')} THEN 3 ELSE 0 END AS r4,
    CASE WHEN {one_of('designation', 'VP', 'Vice President')} THEN 3 WHEN {one_of('designation', 'Head of Sales')} THEN 2 ELSE 0 END AS r5,
    CASE WHEN {one_of('designation', 'xyz')} THEN 3 ELSE 0 END AS r6, CASE WHEN {one_of('designation', 'Data')} THEN 3 ELSE 0 END AS r7,
    CASE WHEN {one_of('designation', 'Senior Director')} THEN 3 WHEN {one_of('designation', 'Director')} AND contains({T.n01('designation')}, 'senior') THEN 2 ELSE 0 END AS r8
  FROM primary_contacts""")  # fmt: skip
def p03(spark, sf_dir):
    strengths = [X.role_match_strength(F.col("designation"), r, ROLES).alias(f"r{k}") for k, r in enumerate(_ASKED)]
    return frame(spark, sf_dir, "primary_contacts").select("seq", *strengths)


@query("P04_role_matches", cte("primary_contacts") + f"""
  SELECT seq, {one_of('designation', 'Director', 'Senior Director', 'Regional Director', 'Area Director', 'Sales Director', 'Director of Sales')} AS generic,
    {one_of('designation', 'Head of Data', 'Data Head')} AS specific, true AS free FROM primary_contacts""")
def p04(spark, sf_dir):
    fits = lambda *r: X.role_matches(F.col("designation"), list(r), ROLES)
    return frame(spark, sf_dir, "primary_contacts").select("seq", fits("Director").alias("generic"), fits("VP", "Head of Data").alias("specific"), fits().alias("free"))


_SHORT = "coalesce(designation, '') || ' ' || substr(notes, 1, 120)"


@query("P05_role_in_title", cte("primary_contacts") + f"""
  SELECT seq, {one_of(_SHORT, 'cmo', 'chief marketing officer')} OR ({T.p01(_SHORT, 'data')} AND {T.p01(_SHORT, 'head')})
    OR ({T.p01(_SHORT, 'chief')} AND {T.p01(_SHORT, 'marketing')} AND {T.p01(_SHORT, 'officer')}) AS fits FROM primary_contacts""")
def p05(spark, sf_dir):
    return frame(spark, sf_dir, "primary_contacts").select("seq", X.role_in_title(F.col("designation"), F.col("notes"), ["CMO", "Data Head"]).alias("fits"))


@query("N22_expand_role_terms", cte("primary_contacts") + f"""
  SELECT seq, CASE {T.n01('designation')} WHEN 'chief marketing officer' THEN 'cmo;chief marketing officer' WHEN 'vp engineering' THEN 'VP Engineering;vp engineering;vice president engineering'
    ELSE designation END AS terms FROM primary_contacts""")
def n22(spark, sf_dir):
    rows = frame(spark, sf_dir, "primary_contacts")
    return rows.select("seq", F.array_join(X.expanded_roles(F.array("designation")), ";").alias("terms"))


_PLACE = f"CASE WHEN {one_of('{x}', 'North', 'thre', 'and the')} THEN 'North' WHEN {one_of('{x}', 'South', 'los', 'le')} THEN 'South' ELSE '' END"
_PLACED = T.n08("CASE seq % 4 WHEN 0 THEN 'Location: Le Puy · ' WHEN 1 THEN 'Location: nowhere | ' ELSE '' END || body")


def place_sql(text: str) -> str:
    given = f"trim(regexp_extract({text}, '(?i)\\bLocation\\s*:\\s*([^·•|\\n]{{2,90}})', 1))"
    return f"coalesce(nullif(CASE WHEN {given} <> '' THEN {_PLACE.replace('{x}', given)} ELSE '' END, ''), {_PLACE.replace('{x}', f'substr({text}, 1, 1400)')})"


@query("P07_location_match", cte("search_rows") + f"SELECT seq, {place_sql(_PLACED)} AS place, 'Not requested' AS free FROM search_rows")
def p07(spark, sf_dir):
    text = F.concat(F.expr("CASE seq % 4 WHEN 0 THEN 'Location: Le Puy · ' WHEN 1 THEN 'Location: nowhere | ' ELSE '' END"), "body")
    rows = frame(spark, sf_dir, "search_rows")
    return rows.select("seq", X.location_match(text, ["North", "South"], PLACES).alias("place"), X.location_match(text, [], PLACES).alias("free"))


@query("P09_industry_match", cte("search_rows") + f"""
  SELECT seq, {one_of('title', 'src1 group', 'SaaS', 'software as a service', 'cloud software')} AS fits FROM search_rows""")
def p09(spark, sf_dir):
    return frame(spark, sf_dir, "search_rows").select("seq", X.industry_match(F.col("title"), ["src1 group", "saas"]).alias("fits"))


_PADDED = "' ' || {x} || ' '"


@query("J13_term_hits", f"""
  WITH terms AS (SELECT DISTINCT split_part(text, ' ', 2) AS term FROM benchmark UNION SELECT DISTINCT split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) FROM benchmark),
  t AS (SELECT term, {T.n01('term')} AS k FROM terms WHERE {T.n01('term')} <> ''), d AS (SELECT doc_id, {T.n01('text')} AS x FROM documents)
  SELECT doc_id, term FROM d JOIN t ON CASE WHEN contains(k, ' ') THEN contains(x, k) OR contains(replace(x, ' ', ''), replace(k, ' ', ''))
    ELSE contains(' ' || x || ' ', ' ' || k || ' ') END""")
def j13(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    terms = items.select(F.split_part("text", F.lit(" "), F.lit(2)).alias("term")).union(
        items.select(F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))))
    return X.term_hits(table(spark, sf_dir, "documents"), "doc_id", "text", terms)


# --- candidates -------------------------------------------------------------------------------------------------------
REQUEST = C.Request(
    roles=["VP Sales", "Director"], locations=["North", "South"], industries=["src1 group", "src2 group", "it"], companies=["Src1 Group", "Src3"],
    include=["a"], exclude=["hand", "inanin"], business_model="B2B", least_confidence=90, role_names=ROLES, place_names=PLACES,
)
LOOSE = C.Request(roles=["VP Sales", "Director"], companies=["Src1 Group"], exclude=["hand"], require_company=False, least_sources=1, role_names=ROLES)


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, sf_dir, "candidates")
    return rows.select(
        "seq", "url", "name", "designation", "company", "title", "body", "query", F.col("title").alias("evidence"),
        F.when(F.col("seq") % 7 == 0, F.array("source", F.lit("bing"))).otherwise(F.array("source")).alias("sources"),
        F.when(F.col("seq") % 5 == 0, "enterprise platform").otherwise("").alias("company_evidence"),
    )


ROWS = """rows AS (SELECT seq, url, name, designation, company, title, body, query, title AS evidence,
  CASE WHEN seq % 7 = 0 THEN [source, 'bing'] ELSE [source] END AS sources, CASE WHEN seq % 5 = 0 THEN 'enterprise platform' ELSE '' END AS company_evidence
  FROM candidates)"""


def over_rows(text: str) -> str:
    return _twin(("candidates",), "SELECT 1").removesuffix("SELECT 1").rstrip() + ",\n" + ROWS + "\n" + text


_VP = one_of("designation", "VP Sales", "Vice President Sales", "Head of Sales")
_VP_ANY = _VP
_DIRECTOR = one_of("designation", "Director", "Sales Director", "Director of Sales", "Senior Director", "Regional Director", "Area Director")
_SEEN = T.n08("title || ' ' || body || ' ' || evidence")
_ALL = T.n08("name || ' ' || designation || ' ' || company || ' ' || title || ' ' || body || ' ' || evidence || ' ' || company_evidence")
_PROOF = T.n08("company || ' ' || designation || ' ' || evidence || ' ' || company_evidence")
_INDUSTRY = one_of(_PROOF, "src1 group", "src2 group", "information technology", "IT services", "software", "technology")
_B2B = one_of(T.n08("company || ' ' || evidence || ' ' || company_evidence"), "b2b", "enterprise", "business customers", "merchant", "api", "platform", "saas",
              "bank partners", "corporate", "payments infrastructure")


def strength_sql(company: str) -> str:
    wanted = f"'{company}'"
    return f"CASE WHEN {T.n01('company')} = {T.n01(wanted)} THEN 3 WHEN list_has_any({T.n17('company')}, {T.n17(wanted)}) THEN 2 ELSE 0 END"


_REASON_SQL = f"""CASE WHEN {one_of(_ALL, 'hand', 'inanin')} THEN 'excluded_terms' WHEN NOT {T.p01(_ALL, 'a')} THEN 'required_terms'
  WHEN NOT {_VP_ANY} THEN 'role' WHEN {place_sql(_SEEN)} = '' THEN 'location' WHEN NOT {_INDUSTRY} THEN 'industry_company'
  WHEN NOT {_B2B} THEN 'business_model' ELSE '' END"""
_KNOWN_COMPANY = f"({strength_sql('Src1 Group')} > 0 OR {strength_sql('Src3')} > 0)"
_SCORE_SQL = f"""least(99, 50 + CASE WHEN {_VP_ANY} THEN 15 ELSE 0 END + CASE WHEN {_KNOWN_COMPANY} THEN 12 ELSE 0 END + CASE WHEN {place_sql(_SEEN)} <> '' THEN 10 ELSE 0 END
  + CASE WHEN {_INDUSTRY} THEN 8 ELSE 0 END + CASE WHEN len(sources) > 1 THEN 5 ELSE 0 END + CASE WHEN company_evidence <> '' THEN 3 ELSE 0 END + 4)"""


@query("P13_filter_reason", over_rows(f"SELECT seq, {_REASON_SQL} AS reason FROM rows"))
def p13(spark, sf_dir):
    return candidate_rows(spark, sf_dir).select("seq", C.filter_reason(REQUEST).alias("reason"))


@query("D01_confidence_score", over_rows(f"SELECT seq, {_SCORE_SQL} AS confidence FROM rows"))
def d01(spark, sf_dir):
    return candidate_rows(spark, sf_dir).select("seq", C.confidence_score(REQUEST).alias("confidence"))


_TEXT = T.n08("designation || ' ' || company || ' ' || evidence")


@query("D02_raw_score", over_rows(f"""
  SELECT seq, CASE WHEN {_VP} THEN 5 ELSE 0 END + CASE WHEN {_DIRECTOR} THEN 5 ELSE 0 END + CASE WHEN {_PLACE.replace('{x}', _TEXT)} <> '' THEN 4 ELSE 0 END
    + CASE WHEN {T.p01(_TEXT, 'src1 group')} THEN 3 ELSE 0 END + CASE WHEN {T.p01(_TEXT, 'src2 group')} THEN 3 ELSE 0 END
    + CASE WHEN {T.p01(_TEXT, 'it')} THEN 3 ELSE 0 END + CASE WHEN lower(company) <> 'unknown' THEN 2 ELSE 0 END AS score FROM rows"""))
def d02(spark, sf_dir):
    return candidate_rows(spark, sf_dir).select("seq", C.raw_score(REQUEST).alias("score"))


@query("P19_evidence_needed", over_rows(f"""
  SELECT seq, NOT {one_of('company', 'Src1 Group', 'Src3')} AND NOT {one_of('evidence', 'src1 group', 'src2 group', 'it')}
    AND lower({T.n08('company')}) NOT IN ('', 'unknown') AS needed FROM rows"""))
def p19(spark, sf_dir):
    return candidate_rows(spark, sf_dir).select("seq", C.evidence_needed(REQUEST).alias("needed"))


def validated_sql(reason: str, score: str, least: int, place: str) -> str:
    return over_rows(f"""
  , judged AS (SELECT *, {score} AS confidence, CASE WHEN url = '' THEN 'invalid_linkedin_url' WHEN NOT ({T.p11('name', 'designation', 'company')}) THEN 'incomplete'
    WHEN why <> '' THEN why WHEN {score} < {least} THEN 'confidence' ELSE '' END AS own FROM (SELECT *, {reason} AS why FROM rows)),
  firsts AS (SELECT url, min(seq) AS first FROM judged WHERE own = '' GROUP BY url),
  told AS (SELECT j.*, CASE WHEN own <> 'invalid_linkedin_url' AND seq > first THEN 'duplicate' ELSE own END AS reason FROM judged j LEFT JOIN firsts f ON f.url = j.url)
  SELECT seq, url, {T.n08('name')} AS name, {T.n08('designation')} AS designation, {T.n08('company')} AS company, reason,
    CASE WHEN reason = '' THEN {place} ELSE '' END AS location, CASE WHEN reason = '' THEN regexp_extract(url, '/in/([^/]+)/$', 1) ELSE '' END AS profile_id,
    array_to_string(list_sort(sources), ', ') AS source, CASE WHEN reason = '' THEN confidence END AS confidence,
    CASE WHEN reason = '' THEN substr({T.n08("evidence || ' ' || company_evidence")}, 1, 1200) ELSE substr({T.n08('evidence')}, 1, 900) END AS evidence
  FROM told""").replace("FROM candidates)\n\n  , judged", "FROM candidates),\n judged")  # fmt: skip


_LOOSE_REASON = f"CASE WHEN {T.p01(_ALL, 'hand')} THEN 'excluded_terms' WHEN NOT {_VP_ANY} THEN 'role' ELSE '' END"
_LOOSE_SCORE = f"""least(99, 50 + CASE WHEN {_VP_ANY} THEN 15 ELSE 0 END + CASE WHEN {strength_sql('Src1 Group')} > 0 THEN 12 ELSE 0 END
  + CASE WHEN len(sources) > 1 THEN 5 ELSE 0 END + CASE WHEN company_evidence <> '' THEN 3 ELSE 0 END)"""


@query("P14_validate", validated_sql(_LOOSE_REASON, _LOOSE_SCORE, 0, "'Not requested'"))
def p14(spark, sf_dir):
    return C.validate(candidate_rows(spark, sf_dir), LOOSE)


@query("P14_validate_strict", validated_sql(_REASON_SQL, _SCORE_SQL, 90, place_sql(_SEEN)))
def p14_strict(spark, sf_dir):
    return C.validate(candidate_rows(spark, sf_dir), REQUEST)


_NAME_KEY = T.n01("name")
_POC = T.n08("name || ' ' || designation || ' ' || company || ' ' || title || ' ' || body || ' ' || evidence")
_ROLE_STRENGTH = f"CASE WHEN {one_of('designation', 'Director')} THEN 3 WHEN {_DIRECTOR} THEN 2 ELSE 0 END"


@query("D03_poc_match", over_rows(f"""
  , made AS (SELECT *, {strength_sql('Src1 Group')} AS c, {_ROLE_STRENGTH} AS r FROM rows WHERE url <> ''),
  why AS (SELECT *, CASE WHEN {_NAME_KEY} IN ('', 'unknown', 'linkedin member', 'new cio', 'new cto', 'new cdo') OR NOT len(string_split({_NAME_KEY}, ' ')) BETWEEN 2 AND 8
      OR regexp_matches(name, '\\d|@') THEN 'invalid_name' WHEN {T.p01(_POC, 'hand')} THEN 'excluded_terms' WHEN c = 0 THEN 'company_mismatch'
      WHEN r = 0 THEN 'designation_mismatch' ELSE '' END AS reason FROM made),
  first AS (SELECT url, min(seq) FILTER (WHERE reason = '') AS ok, min(seq) FILTER (WHERE reason <> '') AS no FROM why GROUP BY url)
  SELECT seq, w.url, reason, CASE WHEN reason = '' THEN least(96, 68 + 4 * c + 4 * r + CASE WHEN len(sources) > 1 THEN 4 ELSE 0 END) END AS score,
    reason IN ('company_mismatch', 'designation_mismatch', 'invalid_name') AS reviewable
  FROM why w JOIN first f ON f.url = w.url WHERE seq = ok OR (seq = no AND (ok IS NULL OR no < ok))""").replace("FROM candidates)\n\n  , made", "FROM candidates),\n made"))
def d03(spark, sf_dir):
    return C.poc_match(candidate_rows(spark, sf_dir), "Src1 Group", "Director", LOOSE).select("seq", "url", "reason", "score", "reviewable")


def quality_sql(kind: str, c: str) -> str:
    key, n = T.n01(c), f"len(list_filter(string_split({T.n01(c)}, ' '), lambda w: w <> ''))"
    base = f"CASE WHEN {key} IN ('', 'unknown', 'none', 'na', 'n a') THEN 0 WHEN {n} > 18 THEN 1 ELSE 10 END"
    if kind == "name":
        return f"CASE WHEN {base} = 0 OR NOT {n} BETWEEN 2 AND 6 OR regexp_matches({c}, '\\d|@') THEN 0 ELSE {base} + greatest(0, 7 - abs({n} - 2)) END"
    if kind == "designation":
        marks = f"len(list_filter(string_split({key}, ' '), lambda w: w IN ({T.quoted(C.ROLE_MARKERS)})))"
        return f"CASE WHEN {base} = 0 THEN 0 ELSE {base} + 3 * {marks} - greatest(0, {n} - 10) END"
    return f"CASE WHEN {base} = 0 OR {n} > 8 THEN 0 ELSE {base} + greatest(0, 6 - {n}) END"


_KINDS = ("name", "designation", "company")


@query("D14_field_quality", over_rows("SELECT seq, " + ", ".join(f"CAST({quality_sql(k, k)} AS INT) AS {k}_quality" for k in _KINDS) + " FROM rows"))
def d14(spark, sf_dir):
    return candidate_rows(spark, sf_dir).select("seq", *[C.field_quality(k, F.col(k)).alias(f"{k}_quality") for k in _KINDS])


@query("A01_merge_candidates", over_rows("""
  , q AS (SELECT *, {n} AS qn, {d} AS qd, {c} AS qc FROM rows WHERE url <> ''),
  texts AS (SELECT url, seq, {e} AS e, {b} AS b FROM q),
  joined AS (SELECT url, coalesce(substr(string_agg(e, ' ' ORDER BY seq) FILTER (WHERE e <> ''), 1, 1800), '') AS evidence,
    coalesce(substr(string_agg(b, ' ' ORDER BY seq) FILTER (WHERE b <> ''), 1, 1800), '') AS body FROM texts GROUP BY url)
  SELECT q.url, min(seq) AS seq, arg_max(name, qn * 1000000000 - seq) AS name, arg_max(designation, qd * 1000000000 - seq) AS designation,
    arg_max(company, qc * 1000000000 - seq) AS company, coalesce(arg_min(title, seq) FILTER (WHERE title <> ''), '') AS title,
    array_to_string(list_sort(list_distinct(flatten(list(sources)))), ';') AS sources, array_to_string(list_sort(list(DISTINCT query)), ';') AS queries,
    any_value(joined.evidence) AS evidence, any_value(joined.body) AS body
  FROM q JOIN joined ON joined.url = q.url GROUP BY q.url""".replace("{n}", quality_sql("name", "name")).replace("{d}", quality_sql("designation", "designation"))
  .replace("{c}", quality_sql("company", "company")).replace("{e}", T.n08("evidence")).replace("{b}", "substr(" + T.n08("body") + ", 1, 1800)")).replace("FROM candidates)\n\n  , q AS", "FROM candidates),\n q AS"))
def a01(spark, sf_dir):
    flat = {c: F.array_join(c, ";") for c in ("sources", "queries")}
    return C.merge_candidates(candidate_rows(spark, sf_dir)).withColumns(flat)


# --- campaigns --------------------------------------------------------------------------------------------------------
@query("M01_recipient_intake", cte("recipients") + f"""
  , r AS (SELECT *, {T.n04('email')} AS e FROM recipients), w AS (SELECT *, CASE WHEN e = '' THEN 'invalid_or_blank_email'
    WHEN upper(trim(decision)) <> 'SAFE TO CONTACT' THEN 'not_safe_to_contact' ELSE '' END AS why FROM r),
  f AS (SELECT e AS fe, min(id) AS first FROM w WHERE why = '' GROUP BY e)
  SELECT id, CASE WHEN why = '' AND id > first THEN 'duplicate_email_in_source' ELSE why END AS reason,
    CASE WHEN why = '' AND id <= first THEN e ELSE trim(email) END AS email, CASE WHEN why = '' AND id <= first THEN split_part(trim(full_name), ' ', 1) ELSE '' END AS first_name
  FROM w LEFT JOIN f ON fe = e AND why = ''""".replace("\n  , r AS", ", r AS"))  # fmt: skip
def m01(spark, sf_dir):
    mapping = {"email": "email", "full_name": "full_name", "decision": "decision"}
    return M.intake(frame(spark, sf_dir, "recipients"), mapping, "id").select("id", "reason", "email", "first_name")


def _wide(spark, sf_dir):
    return frame(spark, sf_dir, "recipients").withColumns({
        "first_name": F.lit(""), "designation": F.lit(""), "profile_url": F.lit(""),
        "source_data": F.create_map(F.lit("Region Code"), F.col("minute").cast("string"), F.lit("Email"), F.lit("other"), F.lit("note"),
                                    F.when(F.col("minute") % 2 == 0, " ").otherwise("<b> & 'q'")),
    })


@query("J06_admit_recipients", cte("recipients") + f"""
  , r AS (SELECT *, {T.n04('email')} AS e FROM recipients), w AS (SELECT *, CASE WHEN e = '' THEN 'invalid_email'
    WHEN e IN (SELECT e FROM r WHERE status = 'BOUNCED' AND e <> '') THEN 'suppressed'
    WHEN e IN (SELECT e FROM r WHERE status NOT IN ('CANCELLED', 'FAILED', 'SKIPPED_SUPPRESSED', 'DRAFT') AND response_classification <> 'RECONTACT_ALLOWED' AND e <> '')
    THEN 'already_in_campaign_history' ELSE '' END AS why FROM r WHERE status = 'DRAFT'), f AS (SELECT e AS fe, min(id) AS first FROM w WHERE why = '' GROUP BY e)
  SELECT id, CASE WHEN why = '' AND id > first THEN 'duplicate_email_in_campaign' ELSE why END AS reason FROM w LEFT JOIN f ON fe = e AND why = ''""".replace("\n  , r AS", ", r AS"))  # fmt: skip
def j06(spark, sf_dir):
    rows = frame(spark, sf_dir, "recipients")
    new, old = rows.where("status = 'DRAFT'"), rows.where("status != 'DRAFT'")
    return M.admit(new, rows.where("status = 'BOUNCED'"), old, "id").select("id", "reason")


@query("M02_recipient_context", cte("recipients") + """
  SELECT id, email, full_name AS name, split_part(trim(full_name), ' ', 1) AS first_name, CAST(minute AS VARCHAR) AS region_code,
    CASE WHEN minute % 2 = 0 THEN ' ' ELSE '<b> & ''q''' END AS note, 9 AS keys FROM recipients""")
def m02(spark, sf_dir):
    c = M.recipient_context()
    return _wide(spark, sf_dir).withColumn("c", c).select("id", *[F.col("c")[k].alias(k) for k in ("email", "name", "first_name", "region_code", "note")], F.size("c").alias("keys"))


_TEMPLATE = "Dear {{ first_name }}, {{note}} for {{company}} ({{region_code}})"


@query("M03_missing_tokens", cte("recipients") + "SELECT id, CASE WHEN minute % 2 = 0 THEN 'note' ELSE '' END AS missing FROM recipients")
def m03(spark, sf_dir):
    return _wide(spark, sf_dir).withColumn("c", M.recipient_context()).select("id", F.array_join(M.missing_tokens(F.col("c"), _TEMPLATE, "{{email}}"), ",").alias("missing"))


@query("M04_render", cte("recipients") + """
  SELECT id, 'Dear ' || split_part(full_name, ' ', 1) || ', ' || CASE WHEN minute % 2 = 0 THEN ' ' ELSE '<b> & ''q''' END || ' for ' || company || ' (' || CAST(minute AS VARCHAR) || ')' AS plain,
    'Dear ' || split_part(full_name, ' ', 1) || ', ' || CASE WHEN minute % 2 = 0 THEN ' ' ELSE '&lt;b&gt; &amp; &#39;q&#39;' END || ' for ' || company || ' (' || CAST(minute AS VARCHAR) || ')' AS html
  FROM recipients""")
def m04(spark, sf_dir):
    rows = _wide(spark, sf_dir).withColumn("c", M.recipient_context())
    return rows.select("id", M.render(_TEMPLATE, F.col("c")).alias("plain"), M.render(_TEMPLATE, F.col("c"), html=True).alias("html"))


@query("M05_materialise_messages", cte("recipients") + """
  SELECT id, campaign_id, email, 'Hello ' || split_part(full_name, ' ', 1) AS subject, '<p>' || company || '</p>' AS html, company AS text,
    TIMESTAMP '2024-03-01 09:00:00' + to_minutes(CAST(minute AS BIGINT)) AS scheduled_at, 'QUEUED' AS status FROM recipients WHERE status IN ('DRAFT', 'QUEUED')""")
def m05(spark, sf_dir):
    rows = _wide(spark, sf_dir)
    slots = rows.select("id", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 09:00:00")) + F.col("minute") * 60).alias("send_at"))
    return M.messages(rows, "Hello {{first_name}}", "<p>{{company}}</p>", "{{company}}", slots)



@query("M06_suppress", cte("recipients", "message_events") + """
  , r AS (SELECT id, status, response_classification FROM recipients), asked AS (SELECT recipient_id, min(occurred_at) AS since FROM message_events
    WHERE event_type = 'BOUNCED' GROUP BY recipient_id)
  SELECT id, CASE WHEN since IS NULL THEN status ELSE 'UNSUBSCRIBED' END AS status, CASE WHEN since IS NULL THEN response_classification ELSE 'DO_NOT_CONTACT' END AS response,
    since AS unsubscribed_at FROM r LEFT JOIN asked ON recipient_id = id""".replace("\n  , r AS", ", r AS"))  # fmt: skip
def m06(spark, sf_dir):
    rows = frame(spark, sf_dir, "recipients").withColumn("unsubscribed_at", F.lit(None).cast("timestamp"))
    return M.suppress(rows, _bounces(spark, sf_dir), _none(spark))[1].select("id", "status", F.col("response_classification").alias("response"), "unsubscribed_at")


def _bounces(spark, sf_dir):
    events = frame(spark, sf_dir, "message_events").where("event_type = 'BOUNCED'")
    return events.select("recipient_id", F.col("occurred_at").alias("at"), F.lit("bounce").alias("reason"), F.lit("mailbox").alias("source"))


def _none(spark):
    return spark.createDataFrame([], "email string")


@query("M06_new_suppressions", cte("recipients", "message_events") + f"""
  , asked AS (SELECT {T.n04('email')} AS email, min(occurred_at) AS since FROM message_events JOIN recipients ON recipients.id = recipient_id WHERE event_type = 'BOUNCED' GROUP BY ALL)
  SELECT email, 'bounce' AS reason, 'mailbox' AS source, since AS "at" FROM asked WHERE email NOT IN (SELECT {T.n04('email')} FROM recipients WHERE status = 'UNSUBSCRIBED')
  """.replace("\n  , asked AS", ", asked AS"))  # fmt: skip
def m06_new(spark, sf_dir):
    rows = frame(spark, sf_dir, "recipients").withColumn("unsubscribed_at", F.lit(None).cast("timestamp"))
    old = rows.where("status = 'UNSUBSCRIBED'").select(M.normalize_email(F.col("email")).alias("email")).distinct()
    return M.suppress(rows, _bounces(spark, sf_dir), old)[0]


_CAMPAIGNS = "SELECT campaign_id AS id, CASE campaign_id % 4 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'SCHEDULED' WHEN 2 THEN 'RUNNING' ELSE 'PAUSED' END AS status FROM recipients GROUP BY campaign_id"


@query("M07_campaign_transition", cte("recipients") + f"""
  , c AS ({_CAMPAIGNS})
  SELECT 'pause' AS action, id, CASE WHEN status IN ('SCHEDULED', 'RUNNING') THEN 'PAUSED' ELSE status END AS status, 0 AS cancelled FROM c
  UNION ALL SELECT 'resume', id, CASE WHEN status = 'PAUSED' THEN 'SCHEDULED' ELSE status END, 0 FROM c
  UNION ALL SELECT 'cancel', id, 'CANCELLED', (SELECT count(*) FROM recipients r WHERE r.campaign_id = c.id AND r.status IN ('DRAFT', 'QUEUED', 'CANCELLED')) FROM c
  UNION ALL SELECT 'complete', id, CASE WHEN status IN ('SCHEDULED', 'RUNNING') AND NOT EXISTS (SELECT 1 FROM recipients r WHERE r.campaign_id = c.id
    AND r.status IN ('QUEUED', 'SENDING')) THEN 'COMPLETED' ELSE status END, 0 FROM c""".replace("\n  , c AS", ", c AS"))  # fmt: skip
def m07(spark, sf_dir):
    rows = frame(spark, sf_dir, "recipients")
    campaigns = rows.select(F.col("campaign_id").alias("id")).distinct().withColumn(
        "status", F.expr("CASE id % 4 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'SCHEDULED' WHEN 2 THEN 'RUNNING' ELSE 'PAUSED' END"))
    out = None
    for action in ("pause", "resume", "cancel", "complete"):
        after, left = M.transition(campaigns, rows, action)
        gone = left.groupBy("campaign_id").agg(F.count(F.when(F.col("status") == "CANCELLED", 1)).alias("n"))
        n = F.col("n") if action == "cancel" else F.lit(0)
        one = after.join(gone, F.col("id") == F.col("campaign_id")).select(F.lit(action).alias("action"), "id", "status", n.cast("long").alias("cancelled"))
        out = one if out is None else out.unionByName(one)
    return out


@query("M09_campaign_sheets", cte("recipients", "message_events") + """
  SELECT 'Recipients' AS sheet, count(*) AS n FROM recipients UNION ALL SELECT 'Events', count(*) FROM message_events
  UNION ALL SELECT 'Replies', count(*) FROM recipients WHERE status = 'REPLIED' UNION ALL SELECT 'Failures and bounces', count(*) FROM recipients WHERE status IN ('FAILED', 'BOUNCED')
  UNION ALL SELECT 'Unsubscribes', count(*) FROM recipients WHERE status = 'UNSUBSCRIBED' UNION ALL SELECT 'Configuration', count(DISTINCT campaign_id) FROM recipients""")
def m09(spark, sf_dir):
    rows = frame(spark, sf_dir, "recipients")
    sheets = M.campaign_sheets(rows.select("campaign_id").distinct(), rows, frame(spark, sf_dir, "message_events"))
    out = None
    for name, df in sheets.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sheet"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("C07_recipients_view", cte("recipients") + """
  SELECT id, campaign_id, email, full_name, '' AS first_name, company, '' AS designation, '' AS profile_url, status, response_classification, '' AS open_count,
    '' AS first_opened_at, '' AS last_opened_at, '' AS click_count, '' AS first_clicked_at, '' AS last_clicked_at, '' AS replied_at, '' AS bounced_at,
    '' AS unsubscribed_at, strftime(TIMESTAMP '2024-03-01 09:00:00' + to_minutes(CAST(minute AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS scheduled_at, '' AS created_at FROM recipients""")
def c07(spark, sf_dir):
    rows = frame(spark, sf_dir, "recipients")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 09:00:00")) + F.col("minute") * 60)
    return M.recipients_view(rows.withColumn("scheduled_at", at))


@query("C07_events_view", cte("message_events") + """
  SELECT id, campaign_id, recipient_id, event_type, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') AS occurred_at FROM message_events""")
def c07_events(spark, sf_dir):
    return M.events_view(frame(spark, sf_dir, "message_events"))


@query("D25_expired_leases", """
  SELECT event_id AS id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-10 00:00:00' THEN 'QUEUED' WHEN event_type = 'click' THEN 'SENDING' ELSE 'SENT' END AS status,
    CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-10 00:00:00' THEN TIMESTAMP '2024-01-10 00:00:00' ELSE ts END AS scheduled_at FROM events""")
def d25(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "SENDING").otherwise("SENT").alias("status"),
        F.col("ts").alias("leased_until"), F.col("ts").alias("scheduled_at"))
    return M.expired_leases(rows, F.lit("2024-01-10 00:00:00").cast("timestamp")).drop("leased_until")


_EVENTS = """SELECT id, recipient_id, occurred_at, CASE WHEN event_type = 'BOUNCED' AND id % 3 = 0 THEN 'UNSUBSCRIBED' ELSE event_type END AS event_type FROM message_events"""


@query("R02_recipient_state", cte("message_events") + f"""
  , e AS ({_EVENTS}), f AS (SELECT recipient_id, list_reduce(list_prepend('SENT', list(event_type ORDER BY occurred_at, id)), lambda s, t:
    CASE WHEN t IN ('REPLIED', 'BOUNCED', 'UNSUBSCRIBED') THEN t WHEN t = 'OPENED' AND s = 'SENT' THEN 'OPENED' WHEN t = 'CLICKED' AND s IN ('SENT', 'OPENED') THEN 'CLICKED' ELSE s END) AS status,
    count(*) FILTER (WHERE event_type = 'OPENED') AS open_count, min(occurred_at) FILTER (WHERE event_type = 'OPENED') AS first_opened_at,
    max(occurred_at) FILTER (WHERE event_type = 'OPENED') AS last_opened_at, count(*) FILTER (WHERE event_type = 'CLICKED') AS click_count,
    min(occurred_at) FILTER (WHERE event_type = 'CLICKED') AS first_clicked_at, max(occurred_at) FILTER (WHERE event_type = 'CLICKED') AS last_clicked_at,
    bool_or(event_type IN ('BOUNCED', 'UNSUBSCRIBED')) AS suppressed FROM e GROUP BY recipient_id)
  SELECT * FROM f""".replace("\n  , e AS", ", e AS"))  # fmt: skip
def r02(spark, sf_dir):
    kind = F.when((F.col("event_type") == "BOUNCED") & (F.col("id") % 3 == 0), "UNSUBSCRIBED").otherwise(F.col("event_type"))
    return M.recipient_state(frame(spark, sf_dir, "message_events").withColumn("event_type", kind))


@query("X20_mailbox_event", cte("message_events") + """
  SELECT id, CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN 'bounce' WHEN 2 THEN 'bounce' WHEN 3 THEN 'bounce' ELSE 'reply' END AS kind FROM message_events""")
def x20(spark, sf_dir):
    sender = F.expr("CASE id % 6 WHEN 0 THEN 'Me <Me@x.org>' WHEN 1 THEN 'Mailer-Daemon@y.org' WHEN 2 THEN 'postmaster@z.org' ELSE 'ann@example.com' END")
    subject = F.expr("CASE id % 6 WHEN 3 THEN 'Undeliverable: hello' WHEN 4 THEN NULL ELSE 'Re: ' || event_type END")
    return frame(spark, sf_dir, "message_events").select("id", M.mailbox_event(sender, subject, F.lit("me@x.org")).alias("kind"))


@query("A08_retry_queue", """
  WITH a AS (SELECT event_id AS seq, user_id AS task, user_id % 3 AS query, event_type AS source, value > 400 AS ok, 'r' || CAST(event_id % 5 AS VARCHAR) AS reason,
    event_id % 11 = 0 AS challenge, event_id % 4 AS attempt FROM events),
  lost AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a w WHERE w.ok AND w.task = a.task AND w.query = a.query)),
  s AS (SELECT task, query, string_agg(source, ', ' ORDER BY first) AS sources FROM (SELECT task, query, source, min(seq) AS first FROM lost GROUP BY ALL) GROUP BY ALL)
  SELECT task, query, any_value(sources) AS sources, arg_max(source, seq) AS last_source, arg_max(reason, seq) AS reason, bool_or(challenge) AS challenge, max(attempt) AS attempts
  FROM lost JOIN s USING (task, query) GROUP BY task, query""")
def a08(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("task"), (F.col("user_id") % 3).alias("query"), F.col("event_type").alias("source"),
        (F.col("value") > 400).alias("ok"), F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("reason"),
        (F.col("event_id") % 11 == 0).alias("challenge"), (F.col("event_id") % 4).alias("attempt"))
    return M.retry_queue(rows)


# --- schemas ----------------------------------------------------------------------------------------------------------
_HEADER = """CASE c_custkey % 13 WHEN 0 THEN 'Name' WHEN 1 THEN 'Full  Name' WHEN 2 THEN 'E-Mail' WHEN 3 THEN 'Organisation' WHEN 4 THEN 'Mobile Number'
  WHEN 5 THEN 'Job Title' WHEN 6 THEN 'Email' WHEN 7 THEN 'LinkedIn' WHEN 8 THEN 'Remarks' WHEN 9 THEN 'Surname' WHEN 10 THEN 'Reply' WHEN 11 THEN 'Date' ELSE 'Other' END"""


def _headers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.expr("c_custkey DIV 5").alias("file"), F.expr(_HEADER).alias("column"))


_FIELDS = """(VALUES ('name', 'full_name'), ('full name', 'full_name'), ('e mail', 'email'), ('email', 'email'), ('organisation', 'company'),
  ('mobile number', 'phone'), ('job title', 'designation'), ('linkedin', 'linkedin_url'), ('remarks', 'notes'), ('surname', 'last_name'), ('reply', 'response'), ('date', 'contact_date'))"""
_DETECTED = f"""h AS (SELECT c_custkey // 5 AS file, {_HEADER} AS "column" FROM customer), hits AS (SELECT file, field, list_sort(list(DISTINCT "column")) AS c
  FROM h JOIN {_FIELDS} t(alias, field) ON alias = {T.n02('"column"')} GROUP BY file, field)"""


@query("C01_detect_columns", f"""WITH {_DETECTED}
  SELECT file, field, CASE WHEN len(c) = 1 THEN c[1] ELSE '' END AS "column", CASE WHEN len(c) = 1 THEN '' ELSE array_to_string(c, ';') END AS ambiguous FROM hits""")
def c01(spark, sf_dir):
    return S.detect_columns(_headers(spark, sf_dir)).withColumn("ambiguous", F.array_join("ambiguous", ";"))


@query("C02_validate_mapping", f"""WITH {_DETECTED}, m AS (SELECT file, field, CASE WHEN field = 'phone' THEN 'Gone' WHEN field = 'designation' THEN 'Email' ELSE c[1] END AS col FROM hits),
  named AS (SELECT DISTINCT m.file FROM m JOIN h ON h.file = m.file AND h."column" = col WHERE field IN ('full_name', 'first_name', 'last_name')),
  twice AS (SELECT file, string_agg(col, ', ' ORDER BY col) AS t FROM (SELECT file, col FROM m GROUP BY ALL HAVING count(*) > 1) GROUP BY file),
  gone AS (SELECT file, string_agg(col, ', ' ORDER BY col) AS g FROM (SELECT DISTINCT file, col FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.file = m.file AND h."column" = col)) GROUP BY file)
  SELECT file, concat_ws(' / ', CASE WHEN file NOT IN (SELECT file FROM named) THEN 'Map Full name or at least one First/Last name column.' END,
    'A source column cannot map to multiple fields: ' || t, 'Mapped columns are missing from the selected sheet: ' || g) AS errors
  FROM (SELECT DISTINCT file FROM h) LEFT JOIN twice USING (file) LEFT JOIN gone USING (file)""")
def c02(spark, sf_dir):
    headers = _headers(spark, sf_dir)
    found = S.detect_columns(headers)
    first = F.when(F.col("column") != "", F.col("column")).otherwise(F.get("ambiguous", F.lit(0)))
    column = F.when(F.col("field") == "phone", "Gone").when(F.col("field") == "designation", "Email").otherwise(first)
    return S.validate_mapping(found.select("file", "field", column.alias("column")), headers).withColumn("errors", F.array_join("errors", " / "))


@query("C06_history_row", cte("history_contacts") + """
  SELECT CAST(seq AS VARCHAR) AS "Previous Record", full_name AS "Previous Name", status AS "Previous Status", owner AS "Primary Original - Owner", '' AS "Primary Original - None"
  FROM history_contacts""")
def c06(spark, sf_dir):
    rows = frame(spark, sf_dir, "history_contacts").withColumn("raw", F.create_map(F.lit("Owner"), F.col("owner")))
    return S.prefixed(rows, {"seq": "Previous Record", "full_name": "Previous Name", "status": "Previous Status"}, "raw", ["Owner", "None"], "Primary Original - ")


@query("C09_resolve_catalog", """
  WITH c AS (SELECT r_name AS id, list(n_name ORDER BY n_name) AS terms FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name),
  a AS (SELECT c_custkey AS key, [c_mktsegment, (SELECT r_name FROM region WHERE r_regionkey = c_nationkey % 5) || ' - all'] AS ids FROM customer)
  SELECT key, ids[1] || ';' || array_to_string(terms, ';') AS terms FROM a JOIN c ON c.id = split_part(ids[2], ' - ', 1)""")
def c09(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    catalog = named.groupBy(F.col("r_name").alias("id")).agg(F.array_sort(F.collect_list("n_name")).alias("terms"))
    asked = table(spark, sf_dir, "customer").join(region, F.col("c_nationkey") % 5 == F.col("r_regionkey")).select(
        F.col("c_custkey").alias("key"), F.array("c_mktsegment", F.concat("r_name", F.lit(" - all"))).alias("ids"))
    return S.resolve_catalog(asked, catalog).withColumn("terms", F.array_join("terms", ";"))


@query("C04_reconcile_schema", cte("lead_rows") + "SELECT name, CAST(seq AS VARCHAR) AS seq, seniority AS senior, company_stage AS company, '' AS phone FROM lead_rows")
def c04(spark, sf_dir):
    return S.reconcile_schema(frame(spark, sf_dir, "lead_rows"), ["name", "seq", "senior", "company", "phone"])




# --- free text --------------------------------------------------------------------------------------------------------
def _told(spark, sf_dir):
    """Texts of documents with sentences about people and companies put between their words, by turns."""
    said = F.expr("""CASE doc_id % 8 WHEN 0 THEN 'Keynote speaker at the summit: Ann Lee. ' WHEN 1 THEN 'Smart speaker system for sale. ' WHEN 2 THEN 'He raised a Series B round. '
      WHEN 3 THEN 'Panelists include Bob Ray and Kim P. at the forum. ' WHEN 4 THEN 'A B2B SaaS platform for enterprise clients. '
      WHEN 5 THEN 'Consumer app and retail customers, D2C. Enterprise sales. ' WHEN 6 THEN 'The GCC and its Captive Centre, award winner. ' ELSE '' END""")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(said, F.coalesce("text", F.lit(""))).alias("body"), "source")


_TOLD = """told AS (SELECT doc_id, source, CASE doc_id % 8 WHEN 0 THEN 'Keynote speaker at the summit: Ann Lee. ' WHEN 1 THEN 'Smart speaker system for sale. ' WHEN 2 THEN 'He raised a Series B round. '
  WHEN 3 THEN 'Panelists include Bob Ray and Kim P. at the forum. ' WHEN 4 THEN 'A B2B SaaS platform for enterprise clients. '
  WHEN 5 THEN 'Consumer app and retail customers, D2C. Enterprise sales. ' WHEN 6 THEN 'The GCC and its Captive Centre, award winner. ' ELSE '' END || coalesce(text, '') AS body FROM documents)"""


@query("D11_assess_signal", f"""WITH {_TOLD}
  SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Past Speaker' WHEN 2 THEN 'Company Growth' WHEN 3 THEN 'Past Speaker' WHEN 6 THEN 'Award Recipient' ELSE 'No Verified Signal' END AS name,
    CASE doc_id % 8 WHEN 0 THEN 95 WHEN 2 THEN 65 WHEN 3 THEN 95 WHEN 6 THEN 88 ELSE 35 END AS score, doc_id % 8 IN (0, 3) AS selected_match FROM told""")
def d11(spark, sf_dir):
    rows = _told(spark, sf_dir).select("doc_id", F.lit("").alias("title"), "body", F.lit("Ann Lee").alias("person"))
    return G.assess_signal(rows, "doc_id", ["panelist"]).select("doc_id", "name", "score", "selected_match")


@query("D12_business_model", f"""WITH {_TOLD}
  SELECT doc_id, CASE doc_id % 8 WHEN 4 THEN 'B2B' WHEN 5 THEN 'Hybrid' ELSE 'Unknown' END AS detected, doc_id % 8 IN (4, 5) AS matched,
    CASE doc_id % 8 WHEN 4 THEN 'High' WHEN 5 THEN 'High' ELSE 'None' END AS confidence FROM told""")
def d12(spark, sf_dir):
    return _told(spark, sf_dir).select("doc_id", G.business_model(F.lit(""), F.col("body"), "B2B").alias("m")).select("doc_id", "m.detected", "m.matched", "m.confidence")


@query("D13_gcc_terms", f"WITH {_TOLD} SELECT doc_id, CASE WHEN doc_id % 8 = 6 THEN 'GCC;Captive Centre' ELSE '' END AS terms FROM told")
def d13(spark, sf_dir):
    return _told(spark, sf_dir).select("doc_id", F.array_join(G.gcc_terms(F.col("body")), ";").alias("terms"))


@query("X14_person_names", f"""WITH {_TOLD}, n AS (SELECT doc_id, list_concat(
    list_filter(regexp_extract_all(regexp_replace(body, '[^\\P{{L}}A-Za-z]', '_', 'g'), '\\b([A-Z][a-z]{{1,15}}(?:\\s+[A-Z][a-z]{{1,15}}){{1,2}})\\b', 1), lambda x: len(list_intersect(regexp_split_to_array(lower(x), '\\s+'), [{T.quoted(G.NOT_NAMES)}])) = 0),
    list_filter(regexp_extract_all(regexp_replace(body, '[^\\P{{L}}A-Za-z]', '_', 'g'), '\\b([A-Z][a-z]{{1,15}}\\s+[A-Z]\\.)', 1), lambda x: NOT list_contains([{T.quoted(G.NOT_NAMES)}], regexp_split_to_array(lower(x), '\\s+')[1]))) AS c FROM told)
  SELECT doc_id, array_to_string(list_filter(c, lambda x, i: length(x) > 3 AND NOT list_contains(list_transform(c[1 : i - 1], lambda y: lower(y)), lower(x))), ';') AS names FROM n""")
def x14(spark, sf_dir):
    return _told(spark, sf_dir).select("doc_id", F.array_join(G.person_names(F.col("body")), ";").alias("names"))


@query("X15_event_participants")
def x15(spark, sf_dir):
    return G.event_participants(_told(spark, sf_dir), "doc_id", "body")


_FACTS = """CASE doc_id % 4 WHEN 0 THEN 'Revenue of $ 1,200 crore in the year, founded in 1998 and headquartered in Pune, India. ' WHEN 1 THEN 'It has 5,000+ employees. Net profit was 30 million. '
  ELSE '' END || coalesce(text, '')"""


@query("X16_company_facts", f"""WITH s AS (SELECT doc_id, source, {_FACTS} AS body FROM documents WHERE source <> '')
  SELECT source, coalesce(arg_min('1,200 crore', doc_id) FILTER (WHERE doc_id % 4 = 0), '') AS revenue, coalesce(arg_min('5000', doc_id) FILTER (WHERE doc_id % 4 = 1), '') AS employees,
    coalesce(arg_min('1998', doc_id) FILTER (WHERE doc_id % 4 = 0), '') AS founded, coalesce(arg_min('Pune', doc_id) FILTER (WHERE doc_id % 4 = 0), '') AS hq,
    coalesce(arg_min('30 million', doc_id) FILTER (WHERE doc_id % 4 = 1), '') AS profit, coalesce(arg_min(substr(body, 1, 500), doc_id) FILTER (WHERE length(body) > 60), '') AS description
  FROM s GROUP BY source""")
def x16(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(_FACTS).alias("body"), F.lit("").alias("href"))
    return G.company_facts(rows, "source", "doc_id").select("source", "revenue", "employees", "founded", "hq", "profit", "description")


@query("X17_company_summary", f"""WITH s AS (SELECT doc_id, {_FACTS} AS body FROM documents)
  SELECT doc_id, CASE WHEN length(body) <= 60 THEN '—' ELSE coalesce(nullif(substr(array_to_string(list_filter(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda x: length(x) > 30)[1 : 2], ' '), 1, 300), ''), '—') END AS description, CASE WHEN doc_id % 4 = 1 THEN '30 million' ELSE '—' END AS profit FROM s""")
def x17(spark, sf_dir):
    said, profit = G.company_summary(F.col("body"))
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_FACTS).alias("body")).select("doc_id", said.alias("description"), profit.alias("profit"))


@query("J08_best_profile_for_person", """
  WITH p AS (SELECT c_custkey AS id, c_custkey % 5 AS k FROM customer)
  SELECT id AS person_id, CASE k WHEN 0 THEN 'matched' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'matched' WHEN 3 THEN 'not_found' ELSE 'ambiguous' END AS match_status,
    CASE k WHEN 0 THEN 'u' || CAST(id AS VARCHAR) || 'a' WHEN 2 THEN 'u' || CAST(id AS VARCHAR) || 'a' ELSE '' END AS url,
    CASE k WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN CAST(0.6 AS DOUBLE) WHEN 2 THEN CAST(0.6 AS DOUBLE) + CAST(0.3 AS DOUBLE) WHEN 3 THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS score FROM p""")
def j08(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("person_id"), F.lit("Dr. Ann Lee").alias("name"), F.lit("Zenith Foods Ltd").alias("company"), F.lit("Head of Data").alias("designation"))
    k = F.col("person_id") % 5
    first = people.select("person_id", F.concat(F.lit("u"), F.col("person_id").cast("string"), F.lit("a")).alias("url"),
                          F.when(k == 3, "Bob Ray").otherwise("Ann Lee").alias("name"), F.when(k == 1, "Other").otherwise("Zenith Foods").alias("company"),
                          F.when(k.isin(0, 4), "the head of data there").otherwise("x").alias("text"))
    second = people.where(k == 4).select("person_id", F.lit("u-second").alias("url"), F.lit("A Lee").alias("name"), F.lit("Zenith Foods").alias("company"), F.lit("data head").alias("text"))
    return G.best_profile(people, first.unionByName(second)).select("person_id", "match_status", "url", "score")


# --- orders -----------------------------------------------------------------------------------------------------------
@query("W01_rank_candidates", _twin(("candidates",), """
  SELECT seq, row_number() OVER (ORDER BY CASE WHEN designation <> 'Unknown' THEN 5 ELSE 0 END + CASE WHEN company <> 'Unknown' THEN 2 ELSE 0 END DESC,
    length(body) DESC, seq) AS rank FROM {candidates}"""))
def w01(spark, sf_dir):
    points = F.when(F.col("designation") != "Unknown", 5).otherwise(0) + F.when(F.col("company") != "Unknown", 2).otherwise(0)
    rows = _frame(spark, sf_dir, "candidates").select("seq", points.alias("points"), F.length("body").alias("size"))
    return R.numbered(rows, [F.desc("points"), F.desc("size"), F.asc("seq")]).select("seq", "rank")


@query("W06_rank_column", cte("lead_rows") + "SELECT seq, row_number() OVER (ORDER BY seq % 13 DESC, seq) AS rank FROM lead_rows")
def w06(spark, sf_dir):
    return R.numbered(frame(spark, sf_dir, "lead_rows").select("seq"), [F.desc(F.col("seq") % 13), F.asc("seq")])


@query("O01_accept_until_target", _twin(("candidates",), """
  SELECT seq, row_number() OVER (ORDER BY length(body) DESC, seq) AS rank FROM {candidates} WHERE url <> '' AND designation <> 'Unknown' QUALIFY rank <= 100"""))
def o01(spark, sf_dir):
    rows = _frame(spark, sf_dir, "candidates").where("url != '' AND designation != 'Unknown'").select("seq", F.length("body").alias("size"))
    return R.first_rows(rows, [F.desc("size"), F.asc("seq")], 100).select("seq", "rank")


@query("J15_enrich_and_blacklist", cte("lead_rows") + """
  SELECT l.seq, coalesce(n_comment_or_name, '—') AS summary, row_number() OVER (ORDER BY l.seq % 13 DESC, l.seq) AS rank
  FROM lead_rows l LEFT JOIN (SELECT n_name, r_name AS n_comment_or_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA') n ON n.n_name = l.country
  WHERE l.seniority <> 'Intern'""")
def j15(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    known = nation.join(region.where("r_name != 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("country"), F.col("r_name").alias("summary"))
    rows = frame(spark, sf_dir, "lead_rows")
    banned = rows.where("seniority = 'Intern'").select("name").distinct()
    kept = rows.join(banned, "name", "left_anti").join(known, "country", "left").select("seq", F.coalesce("summary", F.lit("—")).alias("summary"))
    return R.numbered(kept, [F.desc(F.col("seq") % 13), F.asc("seq")])


@query("K03_interleave", _twin(("search_rows",), """
  SELECT seq, row_number() OVER (ORDER BY rn // w, stage, rn) AS place FROM (SELECT *, CASE stage WHEN 1 THEN 1 ELSE 2 END AS w,
    row_number() OVER (PARTITION BY stage ORDER BY seq) - 1 AS rn FROM (SELECT seq, CASE WHEN source = 'other' THEN 1 ELSE 0 END AS stage FROM {search_rows}) a) b"""))
def k03(spark, sf_dir):
    rows = frame(spark, sf_dir, "search_rows").select("seq", "source")
    return R.interleaved(rows, F.when(F.col("source") == "other", 1).otherwise(0), {0: 2, 1: 1}, [F.asc("seq")]).select("seq", "place")


@query("A09_citation_evidence", _twin(("candidates",), """
  SELECT company, substr(string_agg(body, ' ' ORDER BY seq), 1, 1600) AS evidence FROM {candidates} WHERE contains(lower(body), 'the') GROUP BY company"""))
def a09(spark, sf_dir):
    rows = _frame(spark, sf_dir, "candidates").where(F.lower("body").contains("the")).select("company", "seq", F.substring("body", 1, 1600).alias("t"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("company").orderBy("seq"))).where("n <= 400")  # a text holds 'the' and a space
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x.t), " ")
    return rows.groupBy("company").agg(F.substring(whole, 1, 1600).alias("evidence"))


@query("W05_within_delta_of_best", cte("recipients") + """
  SELECT id, campaign_id FROM (SELECT id, campaign_id, CAST(round(balance) AS BIGINT) % 101 AS score, max(CAST(round(balance) AS BIGINT) % 101) OVER (PARTITION BY campaign_id) AS best FROM recipients) r
  WHERE best - score <= 2""")
def w05(spark, sf_dir):
    rows = frame(spark, sf_dir, "recipients").select("id", "campaign_id", (F.round("balance").cast("bigint") % 101).alias("score"))
    best = rows.groupBy("campaign_id").agg(F.max("score").alias("best"))
    return rows.join(best, "campaign_id").where("best - score <= 2").select("id", "campaign_id")


@query("R04_resume_from_cursor", """
  SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_type = 'signup') OR (event_type <> 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup'))""")
def r04(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = events.where("event_type = 'signup'")
    return M.resume(events, "user_id", done, "event_id").select("event_id")


# --- scores -----------------------------------------------------------------------------------------------------------
@query("D04_composite_lead_scores")  # the twin is table_queries'
def d04(spark, sf_dir):
    return L.composite_lead_scores(frame(spark, sf_dir, "lead_rows")).select("seq", "event_invitation", "dm", "sales", "net", "partnership", "overall")


@query("P12_export_ready", _twin(("candidates",), f"""
  SELECT seq, {T.n01('name')} NOT IN ('', 'unknown', 'none', 'nan', 'na', 'n a', 'null') AND len(string_split({T.n01('name')}, ' ')) <= 8 AND NOT regexp_matches(name, '\\d|@')
    AND company <> 'Unknown' AND seq % 4 <> 3 AND url <> '' AND designation <> 'Unknown' AND seq % 8 <> 1 AS ready FROM {{candidates}}""".replace("{{candidates}}", "{candidates}")))
def p12(spark, sf_dir):
    company = F.when(F.col("seq") % 4 == 3, F.concat("company", F.lit(" seeking"))).otherwise(F.col("company"))
    role = F.when(F.col("seq") % 8 == 1, F.concat(F.lit("We are hiring a "), "designation")).otherwise(F.col("designation"))
    return _frame(spark, sf_dir, "candidates").select("seq", L.export_ready(F.col("name"), company, F.col("url"), role).alias("ready"))


@query("D10_category_match", cte("lead_rows") + f"""
  , h AS (SELECT seq, CAST({one_of('seniority', 'ceo', 'director')} AS INT) AS a, CAST({one_of("industry || ' ' || company_stage", 'fintech', 'unicorn', 'retail')} AS INT) AS b,
    CAST({one_of('country', 'india', 'france', 'china', 'germany', 'united states')} AS INT) AS c,
    CAST(industry = 'SaaS' OR speaker = 'Yes' AS INT) AS d FROM lead_rows)
  SELECT seq, a + b + c + 4 + CASE WHEN speaker = 'Yes' THEN 1 ELSE 0 END AS match_score, a + b + c = 3 AND speaker = 'Yes' AS every
  FROM h JOIN lead_rows USING (seq)""".replace("\n  , h AS", ", h AS"))  # fmt: skip
def d10(spark, sf_dir):
    rows = frame(spark, sf_dir, "lead_rows").withColumn("said", F.when(F.col("speaker") == "Yes", "keynote speaker at a summit").otherwise(""))
    texts = {"role": ["seniority"], "location": ["country"], "industry": ["industry", "company_stage"], "signal": ["awards", "said"], "custom": ["name"], "organization": ["name"]}
    asked = {"role": ["ceo", "director"], "location": ["india", "france", "china", "germany", "united states"], "industry": ["fintech", "unicorn", "retail"], "signal": ["keynote"]}
    return L.category_match(rows, "seq", texts, asked)


@query("D05_evaluate", cte("primary_contacts") + f"""
  , r AS (SELECT *, {one_of('designation', 'cmo', 'chief marketing officer')} OR {one_of('designation', 'sales director')}
      OR ({T.p01('designation', 'sales')} AND {T.p01('designation', 'director')}) OR ({T.p01('designation', 'chief')} AND {T.p01('designation', 'marketing')} AND {T.p01('designation', 'officer')}) AS role,
    seq % 3 <> 0 AS place, seq % 5 <> 0 AS given, seq % 4 = 0 AS told, company <> '' AS known FROM primary_contacts)
  SELECT seq, role AND place AS hard, role AND place AND given AND told AS strict, greatest(50, least(99, CASE WHEN told THEN 95 ELSE 35 END + CASE WHEN role THEN 12 ELSE 0 END
    + CASE WHEN place THEN 10 ELSE 0 END + CASE WHEN given THEN 5 ELSE 0 END + CASE WHEN known THEN 2 ELSE 0 END + CASE WHEN given THEN 6 ELSE 0 END)) AS score FROM r""".replace("\n  , r AS", ", r AS"))  # fmt: skip
def d05(spark, sf_dir):
    rows = frame(spark, sf_dir, "primary_contacts").select(
        "seq", F.col("full_name").alias("name"), "designation", "company", F.when(F.col("seq") % 3 != 0, "Pune, India").otherwise("Rome").alias("location"),
        F.when(F.col("seq") % 5 != 0, "a fintech with enterprise software, B2B").otherwise("").alias("company_evidence"),
        F.when(F.col("seq") % 4 == 0, "keynote speaker").otherwise("").alias("person_evidence"))
    return L.evaluate(rows, "seq", ["CMO", "Sales Director"], ["India"], ["fintech"], ["keynote"], model="B2B")


# --- keys -------------------------------------------------------------------------------------------------------------
@query("S03_existing_url_keys", cte("search_rows") + f"""
  SELECT DISTINCT url FROM (SELECT unnest([{T.n06('title')}, {T.n06('body')}, {T.n06('href')}, {T.n06('source')}, {T.n06('query')}]) AS url FROM search_rows) u WHERE url <> ''""")
def s03(spark, sf_dir):
    return K.existing_url_keys(frame(spark, sf_dir, "search_rows"))


@query("S04_existing_people_keys", cte("history_contacts") + """
  SELECT DISTINCT lower(trim(full_name)) || '|' || lower(trim(company)) AS person FROM history_contacts WHERE trim(full_name) <> ''""")
def s04(spark, sf_dir):
    rows = frame(spark, sf_dir, "history_contacts").select("seq", F.col("full_name").alias(" Full Name"), F.col("company").alias("Organisation"))
    return K.existing_people_keys(rows)


@query("S05_exclusion_keys", cte("primary_contacts") + f"""
  SELECT DISTINCT 'i1' AS import_id, kind, value FROM (SELECT 'url' AS kind, {T.n06('profile_url')} AS value FROM primary_contacts
    UNION ALL SELECT 'identity', {T.n14('full_name', 'company')} FROM primary_contacts) k WHERE value <> ''""")
def s05(spark, sf_dir):
    rows = frame(spark, sf_dir, "primary_contacts").select(F.col("full_name").alias("Name"), F.col("company").alias("Company"), F.col("profile_url").alias("Linked-In URL"))
    return K.exclusion_keys(rows, "i1")


@query("S07_seed_scan", cte("search_rows") + """
  SELECT seq, title FROM search_rows WHERE contains(lower(title || ' ' || body || ' ' || href || ' ' || source || ' ' || query), 'thed')
    OR contains(lower(title || ' ' || body || ' ' || href || ' ' || source || ' ' || query), 'eaux') ORDER BY seq LIMIT 200""")
def s07(spark, sf_dir):
    rows = frame(spark, sf_dir, "search_rows").select("seq", "title", "body", "href", "source", "query")
    return K.seed_scan(rows, '"thed" OR (eaux)'.replace("OR", "or"), "seq", 200).select("seq", "title")


@query("J04_exclude_existing", _twin(("candidates", "history_contacts"), f"""
  SELECT seq FROM {{candidates}} c WHERE url NOT IN (SELECT {T.n06('profile_url')} FROM {{history_contacts}} WHERE {T.n06('profile_url')} <> '')"""))
def j04(spark, sf_dir):
    known = K.existing_url_keys(frame(spark, sf_dir, "history_contacts").select("profile_url"))
    return K.exclude_existing(_frame(spark, sf_dir, "candidates"), known).select("seq")


@query("J05_dedup_scope_filter", _twin(("candidates",), """
  SELECT 'job' AS scope, seq FROM {candidates} c WHERE url NOT IN (SELECT url FROM {candidates} WHERE query = 'de') UNION ALL
  SELECT 'global', seq FROM {candidates} WHERE url NOT IN (SELECT url FROM {candidates} WHERE query IN ('de', 'fr')) UNION ALL SELECT 'none', seq FROM {candidates}"""))
def j05(spark, sf_dir):
    rows = _frame(spark, sf_dir, "candidates")
    seen = rows.where("query IN ('de', 'fr')").select("url", F.col("query").alias("job"))
    out = None
    for scope in ("job", "global", "none"):
        one = K.dedup_scope(rows, seen, scope, "de").select(F.lit(scope).alias("scope"), "seq")
        out = one if out is None else out.unionByName(one)
    return out


@query("W04_top1_with_margin", _twin(("candidates",), """
  SELECT name, CASE WHEN score >= 0.8 AND margin >= 0.1 THEN url ELSE '' END AS url, score, CASE WHEN score >= 0.8 AND margin >= 0.1 THEN 'matched' ELSE 'ambiguous' END AS match_status FROM (
    SELECT *, coalesce(score - lead(score) OVER w, CAST(1 AS DOUBLE)) AS margin, row_number() OVER w AS n FROM (
      SELECT name, url, max(CASE WHEN company = 'Unknown' THEN CAST(0.5 AS DOUBLE) WHEN seq % 3 = 0 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END) AS score
      FROM {candidates} WHERE url <> '' GROUP BY name, url) s WINDOW w AS (PARTITION BY name ORDER BY score DESC, url)) r WHERE n = 1"""))
def w04(spark, sf_dir):
    points = F.when(F.col("company") == "Unknown", 0.5).when(F.col("seq") % 3 == 0, 0.95).otherwise(0.9)
    scored = _frame(spark, sf_dir, "candidates").where("url != ''").groupBy("name", "url").agg(F.max(points).alias("score"))
    return G.top_with_margin(scored, "name").drop("margin")
