"""Queries of the scalar functions and predicates over whole adapter tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as N
from ..session import table
from . import twins as T
from .adapters import cte, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def scalar(name: str, source: str, key: str, columns: dict[str, Callable[[], Column]], sql: dict[str, str] | None) -> None:
    """Registers key and computed columns over an adapter or a given table. Columns are made when the query runs."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = frame(spark, sf_dir, source) if source in _ADAPTED else table(spark, sf_dir, source)
        return df.select(F.col(key), *[make().alias(n) for n, make in columns.items()])

    QUERIES[name] = query
    if sql:
        head = cte(source) if source in _ADAPTED else ""
        ORACLES[name] = head + f"SELECT {key}, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + f" FROM {source}"


_ADAPTED = ("primary_contacts", "history_contacts", "message_events", "recipients", "search_rows", "lead_rows")
col = F.col

scalar("N01_normalize_text", "search_rows", "seq", {"key": lambda: N.normalize_text(col("title"))}, {"key": T.n01("title")})
scalar("N02_normalize_identity_text", "search_rows", "seq", {"key": lambda: N.normalize_identity_text(col("body"))}, {"key": T.n02("body")})
scalar("N03_normalize_company", "primary_contacts", "seq", {"company_key": lambda: N.normalize_company(col("company"))}, {"company_key": T.n03("company")})
scalar("N04_normalize_email", "primary_contacts", "seq", {"address": lambda: N.normalize_email(col("email"))}, {"address": T.n04("email")})
scalar("N05_normalize_phone", "primary_contacts", "seq", {"number": lambda: N.normalize_phone(col("phone"))}, {"number": T.n05("phone")})
_digits = "regexp_replace(trim(phone), '\\D', '', 'g')"
scalar(
    "N05b_normalize_public_phone", "primary_contacts", "seq",
    {"number": lambda: N.normalize_public_phone(col("phone"))},
    {"number": f"CASE WHEN length({_digits}) BETWEEN 8 AND 15 AND len(list_distinct(string_split({_digits}, ''))) > 2 "
               f"AND NOT regexp_full_match({_digits}, '(19|20)\\d{{6}}') "
               f"THEN CASE WHEN starts_with(trim(phone), '+') THEN '+' ELSE '' END || {_digits} ELSE '' END"},
)
_national = f"CASE WHEN starts_with({_digits}, '91') AND length({_digits}) = 12 THEN substr({_digits}, 3) ELSE {_digits} END"
scalar(
    "N05c_phone_type", "primary_contacts", "seq", {"kind": lambda: N.phone_type(col("phone"), col("notes"))},
    {"kind": f"CASE WHEN contains({T.n01('notes')}, 'fax') THEN 'fax' WHEN regexp_matches({_digits}, '^(1800|1860|800)') "
             f"THEN 'toll_free' WHEN regexp_full_match({_national}, '[6-9]\\d{{9}}') THEN 'possible_mobile_or_direct' "
             "ELSE 'business_phone' END"},
)
scalar("N06_normalize_profile_url", "search_rows", "seq", {"url": lambda: N.normalize_profile_url(col("href"))}, {"url": T.n06("href")})
scalar("N07_profile_id", "primary_contacts", "seq", {"slug": lambda: N.profile_id(col("profile_url"))},
       {"slug": f"regexp_extract({T.n06('profile_url')}, '/in/([^/]+)/$', 1)"})
scalar("N08_clean_spaces", "search_rows", "seq", {"clean": lambda: N.clean_spaces(col("body"))}, {"clean": T.n08("body")})
scalar("N12_source_family", "search_rows", "seq", {"family": lambda: N.source_family(col("source"))},
       {"family": "CASE WHEN starts_with(lower(trim(source)), 'google') THEN 'google' ELSE lower(trim(source)) END"})
_key = "regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')".replace("{x}", T.n08("title"))
scalar(
    "N13_template_key", "search_rows", "seq",
    {"key": lambda: N.template_key(col("title")), "compact": lambda: N.key_id(col("title"))},
    {"key": f"CASE WHEN {_key} = '' THEN 'field' WHEN regexp_matches({_key}, '^[0-9]') THEN 'field_' || {_key} ELSE {_key} END",
     "compact": f"replace({T.n01('title')}, ' ', '')"},
)
scalar("N14_person_identity_key", "primary_contacts", "seq", {"identity": lambda: N.person_identity_key(col("full_name"), col("company"))},
       {"identity": T.n14("full_name", "company")})
_url = "'^(?i)(https?)://([^/?#]+)([^?#]*)'".replace("^(?i)", "(?i)^")
scalar(
    "N15_canonical_url", "pages", "page_id", {"canonical": lambda: N.canonical_url(col("url")),
                                              "scope": lambda: N.registrable_scope(N.url_host(col("url")))},
    {"canonical": f"lower(regexp_extract(url, {_url}, 1)) || '://' || lower(regexp_extract(url, {_url}, 2)) || "
                  f"coalesce(nullif(regexp_replace(regexp_extract(url, {_url}, 3), '/{{2,}}', '/', 'g'), ''), '/')",
     "scope": "regexp_replace(lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"},
)
scalar("N16_split_terms", "search_rows", "seq", {"terms": lambda: F.array_join(N.split_terms(col("body")), ";")},
       {"terms": "array_to_string(list_filter(list_transform(regexp_split_to_array(body, '[,\\n]'), lambda t: trim(t)), lambda t: t <> ''), ';')"})
scalar("N17_company_variants", "primary_contacts", "seq", {"variants": lambda: F.array_join(N.company_variants(col("company")), ";")},
       {"variants": f"array_to_string({T.n17('company')}, ';')"})
scalar("N18_name_tokens", "primary_contacts", "seq", {"tokens": lambda: F.array_join(N.name_tokens(F.concat(F.lit("Dr. "), col("full_name"))), " ")},
       {"tokens": "array_to_string({}, ' ')".format(T.n18("'Dr. ' || full_name"))})
scalar("N19_redact", "search_rows", "seq", {"safe": lambda: N.redact(F.concat(F.lit("see https://user:pw@host/x "), col("href")))},
       {"safe": "'see https://***@host/x ' || href"})
scalar("N20_find_profile_urls", "search_rows", "seq", {"found": lambda: F.array_join(N.find_profile_urls(F.concat_ws(" ", col("title"), col("href"), col("href"))), " ")},
       {"found": T.n06("href")})
scalar("N21_json_text", "events", "event_id", {"k": lambda: N.json_text(col("props"), ("missing", "k"))},
       {"k": "coalesce(json_extract_string(props, '$.k'), '')"})
scalar("N23_public_url_ok", "pages", "page_id", {"ok": lambda: N.public_url_ok(col("url"))},
       {"ok": "regexp_matches(url, '^https?://[^/?#@:]+') AND NOT regexp_matches(url, '^https?://[^/?#]*@')"})

_TERMS = ["the", "of the", "group", "und", "la"]
scalar("P01_term_in_text", "search_rows", "seq", {"one": lambda: P.term_in_text(col("body"), "the"), "two": lambda: P.term_in_text(col("body"), F.lit("of the"))},
       {"one": T.p01("body", "the"), "two": T.p01("body", "of the")})
scalar(
    "P02_term_lists", "search_rows", "seq",
    {"any_of": lambda: P.any_term(col("body"), _TERMS), "all_of": lambda: P.all_terms(col("body"), ["the", "and"]),
     "hits": lambda: F.array_join(P.matching_terms(col("body"), _TERMS), ";")},
    {"any_of": T.any_p01("body", _TERMS), "all_of": f"{T.p01('body', 'the')} AND {T.p01('body', 'and')}",
     "hits": "concat_ws(';', " + ", ".join(f"CASE WHEN {T.p01('body', t)} THEN '{t}' END" for t in _TERMS) + ")"},
)
scalar(
    "P06_company_match_strength", "primary_contacts", "seq",
    {"strength": lambda: P.company_match_strength(col("company"), F.concat(F.lit("Brand "), col("notes")))},
    {"strength": f"CASE WHEN {T.n01('company')} = {T.n01('notes')} THEN 3 WHEN list_has_any({T.n17('company')}, "
                 "{}) THEN 2 ELSE 0 END".format(T.n17("'Brand ' || notes"))},
)
scalar("P10_business_model_match", "search_rows", "seq", {"b2b": lambda: P.business_model_match(col("body"), F.lit("B2B")), "free": lambda: P.business_model_match(col("body"), F.lit("Any"))},
       {"b2b": T.any_p01("body", list(P.B2B_TERMS)), "free": "true"})
scalar("P11_clean_identity", "primary_contacts", "seq", {"clean": lambda: P.clean_identity(col("full_name"), col("designation"), col("company"))},
       {"clean": T.p11("full_name", "designation", "company")})
scalar("P15_is_active", "recipients", "id", {"active": lambda: P.is_active(F.lit("true"), col("status"))}, {"active": "lower(status) NOT IN ('inactive', 'draft', 'disabled', 'hidden', 'deleted')"})
scalar("P16_designation_overlap", "primary_contacts", "seq", {"fits": lambda: P.designation_overlap(col("designation"), F.lit("Director Sales, Head of Data, Marketing Officer"))},
       {"fits": T.p16("designation", "'Director Sales, Head of Data, Marketing Officer'")})

scalar("N09_unique_terms", "primary_contacts", "seq", {"terms": lambda: F.array_join(N.unique_terms(F.array(col("company"), F.concat(col("company"), F.lit(" ")), F.lit(""), col("notes"))), ";")},
       {"terms": "trim(company) || ';' || notes"})
scalar("N11_unwrap_redirect", "search_rows", "seq", {"target": lambda: N.unwrap_redirect(F.concat(F.lit("https://s.example/url?x=1&q=https%3A%2F%2Fa.example%2F"), col("seq").cast("string")))},
       {"target": "'https://a.example/' || CAST(seq AS VARCHAR)"})
scalar("N24_similarity", "primary_contacts", "seq", {"ratio": lambda: N.token_sort_ratio(N.normalize_text(col("full_name")), N.normalize_text(col("company")))}, None)
scalar("P17_name_score", "primary_contacts", "seq", {"score": lambda: P.name_score(col("full_name"), F.upper(col("full_name")))},
       {"score": "CASE WHEN full_name = '' THEN 0.0 ELSE 0.6 END"})
