"""Profiles and places from search results, the strict way: what a text says is evidence of a kind, the strongest wins.

A title and a body are cut into segments (at dashes, bars, bullets). A segment is a role, a company, a place or nothing by
what stands in it; each place where a role or company can stand gives one piece of evidence, and the ordered lists ROLES
and COMPANIES say which one counts. Only text that belongs to the result's own card is read: the windows are the rules'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import any_term
from ..functions.text import bound, normalize_profile_url, normalize_text, plain_text, text_of, words
from .results import BEGIN, END

# Fixed values of the data rules.
ROLE_TERMS = (
    "ceo", "chief executive officer", "founder", "co founder", "managing director", "md", "president", "vice president", "vp", "svp",
    "avp", "director", "chief", "cmo", "cto", "cio", "cfo", "coo", "cpo", "cro", "chro", "ciso", "cdo", "head", "partner", "manager",
    "officer", "chairman", "chairperson", "chair", "owner", "principal", "lead",
)
COUNTRIES = ("india", "united states", "usa", "united kingdom", "uk", "singapore", "united arab emirates", "uae", "canada", "australia")
AMBIGUOUS_PLACES = ("ncr", "ny", "uk", "uae", "bkc")
NO_COMPANY = ("linkedin", "linkedin profile", "professional profile")
TITLE_COUNTRIES = ("India", "United States", "Singapore", "UAE", "UK")
EDGES = " \t\r\n-–—,;:"
CUT = r"\s*[|·•]\s*"
NOW = (
    r"(?i)^(?:currently\s+)?(?:serving|working)\s+as\s+(?:the|a|an)?\s*([^,.|·]{3,120})",
    r"(?i)^as\s+(?:the|a|an)\s+([^,.|·]{3,120})",
    rf"(?i){BEGIN}i\s+am\s+(?:currently\s+)?(?:the|a|an)\s+([^,.|·]{{3,120}})",
)
#: The order in which evidence counts.
ROLES = ("card", "body_fuller", "title", "current", "title_field")
COMPANIES = ("experience", "card", "body", "title", "current", "current_value", "company_field")


def fragment(c: Column, bars: bool = False) -> Column:
    """A field up to its first bullet or line end (and bar, unless bars stay), without edges."""
    cut = r"(?s)[·•\n].*$" if bars else r"(?s)[·•|\n].*$"
    return F.btrim(F.regexp_replace(F.regexp_replace(text_of(c), cut, ""), r"\s+", " "), F.lit(EDGES))


def company_fragment(c: Column) -> Column:
    bare = F.regexp_replace(fragment(c), rf"(?i)\s+(?:recruiting|hiring)\s+(?:the|for|our|a|an){END}.*$", "")
    return F.btrim(bare, F.lit(EDGES))


def is_role(c: Column) -> Column:
    """A role's term as a word of its own (P01). Accents split words there, so what is left of an accented word ("Ción") may
    look like a short term; a term of one word has to stand in the text itself too, between ends of words in any script."""
    one, several = ([t for t in ROLE_TERMS if (" " in t) == long] for long in (False, True))
    whole = rf"(?i)(?<![\p{{L}}\p{{N}}\p{{M}}])(?:{'|'.join(one)})(?![\p{{L}}\p{{N}}\p{{M}}])"
    return bound(c, lambda x: (x.rlike(whole) & any_term(x, one)) | any_term(x, several))


def is_place(c: Column) -> Column:
    return c.contains(",") & any_term(c, list(COUNTRIES))


def is_company(c: Column) -> Column:
    """What may stand for a company: neither a role nor a place."""
    return (c != "") & ~is_role(c) & ~is_place(c)


_PAIR = "struct<role:string,company:string>"


def _pair(role: Column, company: Column) -> Column:
    return F.struct(role.alias("role"), company.alias("company"))


def _none() -> Column:
    return _pair(F.lit(""), F.lit(""))


def _first(array: Column) -> Column:
    return F.coalesce(F.get(array, F.lit(0)), _none())


def role_at_company(c: Column) -> Column:
    """The last segment that says "role at company"."""
    shape = r"(?is)^\s*(.+?)\s+(?:at|@)\s+(.+?)\s*$"
    pieces = F.reverse(F.filter(F.split(c, CUT), lambda s: F.trim(s) != ""))
    found = F.filter(F.transform(pieces, lambda s: _pair(F.regexp_extract(s, shape, 1), F.regexp_extract(s, shape, 2))), lambda p: (p.role != "") & is_role(p.role))
    return bound(_first(found), lambda p: _pair(fragment(F.regexp_replace(p.role, r"(?i)^\s*(?:Current|Title)\s*:\s*", "")), fragment(p.company)))


def _title_parts(title: Column) -> Column:
    bare = F.trim(F.regexp_replace(text_of(title), rf"(?i)\s*\|\s*(?:LinkedIn|Professional Profile){END}.*$", ""))
    bare = F.trim(F.regexp_replace(bare, r"(?s)(?:\.{3}|…).*$", ""))
    cut = lambda t, pattern, bars: F.filter(F.transform(F.split(t, pattern), lambda p: fragment(p, bars)), lambda p: p != "")
    return bound(bare, lambda t: bound(cut(t, r"\s+[-–—]\s+", True), lambda p: F.when((F.size(p) == 1) & t.contains("|"), cut(t, r"\s*\|\s*", False)).otherwise(p)))


def _title_evidence(fields: Column) -> Column:
    """Role and company of a title's fields: "role at company" anywhere; else the first role with the field after it (or the
    one before, if it is the last), else the first field as a company."""
    said = F.filter(F.transform(fields, role_at_company), lambda p: p.role != "")
    at = F.get(F.filter(F.transform(fields, lambda f, i: F.when(is_role(f), i)), lambda i: i.isNotNull()), F.lit(0))
    beside = lambda k: F.coalesce(F.get(fields, k), F.lit(""))

    def by_role(k: Column) -> Column:
        other = F.when(k + 1 < F.size(fields), beside(k + 1)).when(k > 0, beside(k - 1)).otherwise(F.lit(""))
        return bound(other, lambda o: _pair(F.coalesce(F.get(fields, k), F.lit("")), F.when(is_company(o), o).otherwise(F.lit(""))))

    alone = _pair(F.lit(""), F.when(is_company(beside(F.lit(0))), beside(F.lit(0))).otherwise(F.lit("")))
    return F.when(F.size(said) > 0, F.get(said, F.lit(0))).when(at.isNotNull(), bound(at, by_role)).otherwise(alone)


def _body_evidence(body: Column) -> Column:
    """A current role (and company) in the card's lead: a sentence of the first person, "role at company", or a role to begin
    with. Recruiting posts say nothing of their author."""
    text = F.trim(F.regexp_replace(body, r"\s+", " "))
    lead = F.btrim(F.get(F.split(F.substring(text, 1, 600), rf"(?i){BEGIN}(?:Experience|Education|Location)\s*:", 2), F.lit(0)), F.lit(" ·•|"))
    hiring = rf"(?i)^(?:i(?:'m| am)\s+hiring|hiring|looking|seeking|need|wanted){END}"

    def evidence(t: Column) -> Column:
        spoken = [bound(F.get(F.split(fragment(F.regexp_extract(t, p, 1)), r"(?i)\s+(?:at|@)\s+", 2), F.lit(0)), lambda r: F.when(is_role(r), _pair(r, F.lit("")))) for p in NOW]
        said = F.filter(F.transform(F.split(F.substring(t, 1, 300), CUT), role_at_company), lambda p: p.role != "")
        opening = F.get(F.split(t, rf"{CUT}|(?<=[.!?])\s+", 2), F.lit(0))
        opening = fragment(F.get(F.split(opening, rf"(?i)\s+[-–—]\s+(?=\d|{BEGIN}years?{END}|{BEGIN}yrs?{END})", 2), F.lit(0)))
        opened = bound(opening, lambda o: F.when((F.length(o) <= 140) & is_role(o), _pair(o, F.lit(""))))
        return F.when((t == "") | t.rlike(hiring), _none()).otherwise(F.coalesce(*spoken, F.get(said, F.lit(0)), opened, _none()))

    return bound(lead, evidence)


def _card_segments(body: Column) -> Column:
    return F.filter(F.transform(F.split(F.substring(body, 1, 650), r"\s*[·•]\s*"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def _card_evidence(segments: Column, name: Column, hint: Column) -> Column:
    """place, role and company of a card that begins "place · role · company": not if the first segment is the name or a
    role, or if neither the second one nor the hint is a role."""
    part = lambda k: F.coalesce(F.get(segments, F.lit(k)), F.lit(""))
    key, first = normalize_text(name), normalize_text(part(0))
    named = (key != "") & ((first == key) | F.startswith(first, F.concat(key, F.lit(" "))))
    role = F.when(is_role(part(1)), fragment(part(1))).otherwise(F.lit(""))
    fits = (F.size(segments) >= 2) & (first != "") & ~named & ~is_role(part(0)) & ((role != "") | (hint != ""))
    tokens = F.regexp_extract_all(name, F.lit(r"([A-Za-z0-9]+)"), F.lit(1))
    own = F.concat(F.lit(rf"(?i){BEGIN}"), F.array_join(tokens, r"[^\p{L}\p{N}]+"), F.lit(END))

    def company(third: Column) -> Column:
        at = lambda text: F.when(text != "", F.instr(F.lower(third), F.lower(text)))
        cuts = F.filter(F.array(
            F.regexp_instr(third, F.lit(rf"(?i){BEGIN}Experience{END}")), F.regexp_instr(third, F.lit(rf"(?i){BEGIN}As\s+(?:the|a|an){END}")),
            F.when(F.size(tokens) > 0, F.regexp_instr(third, own)), at(role), at(hint)), lambda x: x > 0)
        cut = bound(F.array_min(cuts), lambda x: F.when(x > 1, F.substring(third, F.lit(1), x - 1)).otherwise(third))
        return bound(company_fragment(cut), lambda c: F.when(F.size(words(normalize_text(c))).between(1, 12) & is_company(c), c).otherwise(F.lit("")))

    return F.when(fits, F.struct(part(0).alias("place"), role.alias("role"), F.when(F.size(segments) >= 3, company(part(2))).otherwise(F.lit("")).alias("company"))).otherwise(
        F.struct(F.lit("").alias("place"), F.lit("").alias("role"), F.lit("").alias("company")))


def profile_is_owners(body: Column, name: Column) -> Column:
    """False if the text is marked as the view of another person's profile."""
    marked = normalize_text(F.regexp_extract(F.substring(body, 1, 700), rf"(?i){BEGIN}View\s+(.{{1,100}}?)[’']s\s+profile\s+on\s+LinkedIn{END}", 1))
    key = normalize_text(name)
    begins = lambda a, b: F.startswith(a, F.concat(b, F.lit(" ")))
    return (marked == "") | (key == "") | (marked == key) | begins(marked, key) | begins(key, marked)


def parse_profiles(rows: DataFrame, title: str = "title", href: str = "href", body: str = "body") -> DataFrame:
    """Rows with name, designation, company and url; all null where href is no profile. A mention of experience counts as
    the current company only on a card with a place or connections, of this person; nothing known: Unknown, and an empty
    designation. Columns of these names are replaced."""
    size = lambda c: F.size(words(normalize_text(c)))
    own = [c for c in rows.columns if c not in ("name", "designation", "company", "url")]
    field = lambda pattern, most: F.regexp_extract("__b", rf"(?i){BEGIN}{pattern}\s*:\s*([^·•|\n]{{2,{most}}})", 1)
    df = rows.select("*", normalize_profile_url(F.col(href)).alias("__url"), text_of(F.col(body)).alias("__b"), _title_parts(F.col(title)).alias("__parts"))
    df = df.withColumn("__name", F.coalesce(F.get("__parts", F.lit(0)), F.lit("Unknown")))
    df = df.withColumns({"__title": _title_evidence(F.slice("__parts", 2, 1_000_000)), "__body": _body_evidence(F.col("__b"))})
    fuller = (F.col("__title.role") == "") | (F.col("__body.company") != "") | (size(F.col("__body.role")) > size(F.col("__title.role")))
    df = df.withColumn("__fuller", F.when(fuller, F.col("__body.role")).otherwise(F.lit("")))
    df = df.withColumn("__hint", F.when(F.col("__fuller") != "", F.col("__fuller")).otherwise(F.col("__title.role")))
    df = df.withColumn("__card", _card_evidence(_card_segments(F.col("__b")), F.col("__name"), F.col("__hint")))
    df = df.withColumn("__value", fragment(field("Current", 140)))
    df = df.withColumn("__current", role_at_company(F.col("__value")))
    titled, employer = field("Title", 100), fragment(field(r"(?:Current\s+Company|Company)", 100))
    schema = F.col("__b").rlike(rf"(?i){BEGIN}Location\s*:|{BEGIN}\d[\d,+]*\s+connections?\s+on\s+LinkedIn{END}")
    worked = fragment(F.regexp_extract(F.substring("__b", 1, 420), rf"(?i){BEGIN}Experience\s*:\s*([^·•|\n]{{2,120}})", 1))
    only = lambda test, c: F.when(test, c).otherwise(F.lit(""))
    roles = {
        "card": F.col("__card.role"), "body_fuller": F.col("__fuller"), "title": F.col("__title.role"), "current": F.col("__current.role"),
        "title_field": only(is_role(titled), fragment(titled)),
    }
    companies = {
        "experience": only(schema & profile_is_owners(F.col("__b"), F.col("__name")) & ~is_role(worked), worked), "card": F.col("__card.company"),
        "body": F.col("__body.company"), "title": F.col("__title.company"), "current": F.col("__current.company"),
        "current_value": only((F.col("__current.role") == "") & is_company(F.col("__value")), F.col("__value")), "company_field": only(is_company(employer), employer),
    }
    strongest = lambda found, order: F.coalesce(*[F.nullif(found[k], F.lit("")) for k in order], F.lit(""))
    name = F.trim(F.regexp_replace("__name", r"(?i)\s*(linkedin|profile).*", ""))
    role = F.regexp_replace(fragment(strongest(roles, ROLES)), r"(?i)^(?:currently\s+(?:serving|working)\s+as|as)\s+(?:the|a|an)?\s*", "")
    company = company_fragment(strongest(companies, COMPANIES))
    known = F.when((company != "") & ~normalize_text(company).isin(*NO_COMPANY), company).otherwise(F.lit("Unknown"))
    given = F.col("__url") != ""
    return df.select(
        *own, F.when(given, name).alias("name"), F.when(given, F.trim(role)).alias("designation"), F.when(given, known).alias("company"), F.when(given, F.col("__url")).alias("url"))


def profile_location(body: Column, title: Column, places: list[str], strict: bool = False, name: Column | None = None) -> Column:
    """The evidence that a profile is in one of the places: its "Location:" fields, its card's first segment, a place in
    the first 420 characters (unless strict), a place field of its title; empty without evidence, "Not requested" without
    places. Short ambiguous names count in the first two only."""
    if not places:
        return F.lit("Not requested")
    name = F.lit("") if name is None else name
    safe = [p for p in places if plain_text(p) not in AMBIGUOUS_PLACES]
    body, title = text_of(body), text_of(title)
    owners = profile_is_owners(body, name)
    first = lambda array, terms: F.get(F.filter(array, lambda x: any_term(x, terms)), F.lit(0)) if terms else F.lit(None).cast("string")
    fields = F.transform(F.regexp_extract_all(F.substring(body, 1, 650), F.lit(rf"(?i){BEGIN}Location\s*:\s*([^\n·•|]{{2,80}})"), F.lit(1)), lambda x: fragment(x))
    hint = F.when(is_role(title), title).otherwise(F.lit(""))
    card = _card_evidence(_card_segments(body), name, hint).place
    early = []
    if not strict:
        said = [*safe, *(["Delhi NCR", "National Capital Region"] if "ncr" in map(plain_text, places) else [])]
        early = [F.when(any_term(F.substring(body, 1, 420), [p]), F.lit(p)) for p in said]
    shown = F.transform(F.regexp_extract_all(title, F.lit(rf"(?i)\s[-–]\s([^|]{{2,90}})\|\s*(?:professional profile|linkedin){END}"), F.lit(1)), lambda x: F.trim(x))
    shown = F.filter(shown, lambda x: x.contains(",") | any_term(x, list(TITLE_COUNTRIES)))
    return F.coalesce(
        F.when(owners, first(fields, places)), F.when(owners & (card != "") & any_term(card, places), card), *early, first(shown, safe), F.lit(""))
