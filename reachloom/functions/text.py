"""Normalisers and other scalar functions as Column expressions (no UDFs).

Public values are empty strings where nothing is known; a null input counts as empty. Regular expressions and fixed
lists follow the data rules, not any engine: each function's SQL twin is in plans/twins.py.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters that decompose to an ASCII letter and marks, and those ASCII letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha() and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
#: Combining marks, and the blocks of Latin letters beyond ASCII, as ranges of a character class.
MARKS = "̀-ͯ"
LATIN = "À-ɏḀ-ỿ"

# Fixed values of the data rules.
LEGAL_SUFFIXES = (
    "private limited", "pvt limited", "pvt ltd", "limited liability partnership", "llp", "limited", "ltd",
    "incorporated", "inc", "llc", "plc",
)
RESERVED_SLUGS = ("404", "company", "feed", "job", "jobs", "pub", "pulse", "posts", "school")
COMPANY_NOISE = (
    "co", "company", "corp", "corporation", "financial", "group", "inc", "india", "limited", "llc", "ltd", "payment",
    "payments", "private", "pvt", "services", "solutions", "systems", "technologies", "technology", "bank", "banks",
    "singapore", "asia",
)
HONORIFICS = ("dr", "mr", "mrs", "ms", "prof", "shri", "smt")
UNKNOWN_VALUES = ("", "unknown", "none", "nan", "na", "n a")
BLOCKED_PATH_TERMS = (
    "login", "log-in", "signin", "sign-in", "signup", "sign-up", "auth", "account", "checkout", "subscribe",
)
RELEVANT_PATH_TERMS = (
    "contact", "about", "leadership", "team", "management", "executive", "press", "media", "news", "investor",
    "corporate", "office",
)
#: Calling code, national length range and allowed first digits by region: validity by length and lead digit only.
REGIONS = {"IN": ("91", 10, 10, "6789"), "US": ("1", 10, 10, "23456789"), "GB": ("44", 9, 10, "12378"),
           "DE": ("49", 7, 11, "123456789"), "SG": ("65", 8, 8, "3689")}


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_spaces(c: Column) -> Column:
    """Null to empty, runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(text_of(c), r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """ASCII letters and digits in lower case, one space for everything else; an accent splits its word."""
    spaced = F.translate(F.regexp_replace(text_of(c), f"([{LATIN}])", "$1 "), ACCENTED, PLAIN)
    joined = F.regexp_replace(F.replace(spaced, F.lit("&"), F.lit(" and ")), "[‐-―]", "-")
    return F.trim(F.regexp_replace(F.lower(joined), "[^a-z0-9]+", " "))


def plain_text(value: str) -> str:
    """N01 for a literal."""
    marked = "".join(c if c.isascii() else " " if unicodedata.combining(c) else c for c in unicodedata.normalize("NFKD", value))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in marked.replace("&", " and ").lower()).split())


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once however often use() names it."""
    return F.transform(F.array(value), use)[0]


def normalize_identity_text(c: Column) -> Column:
    """Case folded, accents dropped, letters and digits of any script kept, the rest one space."""
    plain = F.regexp_replace(F.translate(text_of(c), ACCENTED, PLAIN), f"[{MARKS}]", "")
    folded = F.replace(F.lower(F.replace(plain, F.lit("&"), F.lit(" and "))), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def normalize_company(c: Column) -> Column:
    """N02 without trailing legal suffixes, however many."""
    return F.trim(F.regexp_replace(normalize_identity_text(c), f"((^| )({'|'.join(LEGAL_SUFFIXES)}))+$", ""))


def normalize_email(c: Column) -> Column:
    """N04."""
    plain = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
    return bound(F.lower(clean_spaces(c)), lambda v: F.when(v.rlike(plain), v).otherwise(F.lit("")))


def normalize_phone(c: Column, region: str = "IN") -> Column:
    """+<calling code><national number>, or empty. Numbers with a plus are looked up by their calling code."""

    def valid(code: str, short: int, long: int, leads: str, national: Column) -> Column:
        good = F.length(national).between(short, long) & F.substring(national, 1, 1).isin(*leads)
        return F.when(good, F.concat(F.lit("+" + code), national))

    def after(number: Column, code: str) -> Column:
        return F.substring(number, len(code) + 1, 99)

    code, short, long, leads = REGIONS[region]

    def abroad(number: Column) -> Column:
        return F.coalesce(*[F.when(number.startswith(r[0]), valid(*r, after(number, r[0]))) for r in REGIONS.values()])

    def home(number: Column) -> Column:
        coded = F.when(number.startswith(code) & (F.length(number) > long), valid(code, short, long, leads, after(number, code)))
        return F.coalesce(coded, valid(code, short, long, leads, number))

    def number(raw: Column) -> Column:
        digits = F.regexp_replace(raw, r"\D", "")
        return (
            F.when(raw.startswith("00"), bound(F.substring(digits, 3, 99), abroad))
            .when(raw.startswith("+"), bound(digits, abroad))
            .otherwise(bound(F.regexp_replace(digits, "^0", ""), home))
        )

    return F.coalesce(bound(clean_spaces(c), number), F.lit(""))


def normalize_public_phone(c: Column) -> Column:
    """8 to 15 digits with a leading plus kept; no dates, no placeholders of one or two digits."""
    raw = F.trim(F.coalesce(F.try_url_decode(F.replace(text_of(c), F.lit("+"), F.lit("%2B"))), text_of(c)))
    raw = F.regexp_replace(raw, r"(?i)\s*(?:ext(?:ension)?\.?|x)\s*\d+\s*$", "")
    digits = F.regexp_replace(raw, r"\D", "")
    good = (
        F.length(digits).between(8, 15)
        & (F.size(F.array_distinct(F.split(digits, ""))) > 2)
        & ~digits.rlike(r"^(?:19|20)\d{6}$")
    )
    return F.when(good, F.when(raw.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)).otherwise(F.lit(""))


def phone_type(phone: Column, evidence: Column) -> Column:
    """N05c."""
    digits = F.regexp_replace(text_of(phone), r"\D", "")
    national = F.when(digits.startswith("91") & (F.length(digits) == 12), F.substring(digits, 3, 10)).otherwise(digits)
    return (
        F.when(normalize_text(evidence).contains("fax"), "fax")
        .when(digits.rlike("^(1800|1860|800)"), "toll_free")
        .when(national.rlike(r"^[6-9]\d{9}$"), "possible_mobile_or_direct")
        .otherwise("business_phone")
    )


def normalize_profile_url(c: Column, host: str = "linkedin.com") -> Column:
    """Https://www.<host>/in/<slug>/ for profile pages of the host and its subdomains, else empty."""
    raw = F.trim(text_of(c))
    raw = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), F.regexp_replace(raw, "^/+", "")))
    site = host.replace(".", r"\.")
    slug = F.lower(F.trim(F.regexp_extract(
        raw, rf"^[^:/?#]+://(?:[^/?#@]*@)?(?i:(?:[^/?#:@\[\]]+\.)?{site})\.*(?::\d*)?/(?i:in|mwlite/profile/in)/([^/?#]+)", 1)))
    bad = lambda x: (x == "") | x.isin(*RESERVED_SLUGS) | (F.length(x) > 100)
    return bound(slug, lambda x: F.when(bad(x), F.lit("")).otherwise(F.concat(F.lit(f"https://www.{host}/in/"), x, F.lit("/"))))


def profile_id(c: Column, host: str = "linkedin.com") -> Column:
    """The last path segment of N06."""
    return F.regexp_extract(normalize_profile_url(c, host), "/in/([^/]+)/$", 1)


def unique_terms(terms: Column) -> Column:
    """Cleaned terms without blanks; of terms alike under N01 the first."""
    cleaned = F.filter(F.transform(terms, clean_spaces), lambda t: t != "")
    return F.aggregate(
        cleaned,
        F.array().cast("array<string>"),
        lambda acc, t: F.when(F.exists(acc, lambda a: normalize_text(a) == normalize_text(t)), acc).otherwise(
            F.concat(acc, F.array(t))
        ),
    )


def unwrap_redirect(c: Column) -> Column:
    """The target of a search redirect; anything else unchanged."""
    raw = text_of(c)
    path = F.regexp_extract(raw, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)
    param = lambda k: F.try_url_decode(F.regexp_extract(raw, rf"[?&]{k}=([^&#]*)", 1))
    full = lambda v: F.when(v != "", v)
    coded = F.regexp_extract(raw, r"[?&]u=a1([^&#]*)", 1)
    padded = F.rpad(coded, 4 * 4096, "=")
    plain = F.translate(F.substring(padded, F.lit(1), (F.ceil(F.length(coded) / 4) * 4).cast("int")), "-_", "+/")
    decoded = F.decode(F.try_to_binary(plain, F.lit("base64")), "UTF-8")
    return F.coalesce(
        F.when(path.isin("/url", "/imgres"), F.coalesce(full(param("q")), full(param("url")))),
        full(param("uddg")),
        F.when(coded.rlike("^[A-Za-z0-9_=-]+$") & decoded.startswith("http"), decoded),
        raw,
    )


def source_family(c: Column) -> Column:
    """N12."""
    name = F.lower(F.trim(text_of(c)))
    return F.when(name.startswith("google"), F.lit("google")).otherwise(name)


def independent_families(sources: Column) -> Column:
    """Number of different families."""
    return F.size(F.array_distinct(F.filter(F.transform(sources, source_family), lambda x: x != "")))


def template_key(c: Column) -> Column:
    """A header as [a-z0-9_] key."""
    key = F.regexp_replace(F.regexp_replace(F.lower(clean_spaces(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(key == "", F.lit("field")).when(key.rlike("^[0-9]"), F.concat(F.lit("field_"), key)).otherwise(key)


def key_id(c: Column) -> Column:
    """N01 without spaces."""
    return F.replace(normalize_text(c), F.lit(" "), F.lit(""))


def person_identity_key(name: Column, company: Column) -> Column:
    """N14."""
    n, k = normalize_text(name), normalize_text(company)
    return F.when(n.isin(*UNKNOWN_VALUES) | k.isin(*UNKNOWN_VALUES), F.lit("")).otherwise(F.concat_ws("|", n, k))


def canonical_url(c: Column) -> Column:
    """Https by default, lower-case host, single slashes in the path, no query or fragment; empty if not http."""
    raw = F.trim(text_of(c))
    raw = F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), raw).otherwise(F.concat(F.lit("https://"), raw))
    pattern = r"^(?i)(https?)://([^/?#]+)([^?#]*)"
    scheme, host = F.lower(F.regexp_extract(raw, pattern, 1)), F.lower(F.regexp_extract(raw, pattern, 2))
    path = F.regexp_replace(F.regexp_extract(raw, pattern, 3), "/{2,}", "/")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(host == "", F.lit("")).otherwise(F.concat(scheme, F.lit("://"), host, path))


def registrable_scope(host: Column) -> Column:
    """N15."""
    return F.regexp_replace(F.regexp_replace(F.lower(text_of(host)), r"^\.+|\.+$", ""), r"^www\.", "")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(text_of(c), r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def url_path(c: Column) -> Column:
    return F.regexp_extract(text_of(c), r"^(?i)https?://[^/?#]+([^?#]*)", 1)


def has_path_term(path: Column, terms: tuple[str, ...]) -> Column:
    padded = F.concat(F.lit(" "), normalize_text(path), F.lit(" "))
    plain = [t.replace("-", " ") for t in terms]
    return reduce(lambda a, b: a | b, [padded.contains(f" {t} ") for t in plain])


def is_allowed_url(url: Column, allowed_host: Column) -> Column:
    """Same site, and no blocked term in the path."""
    host = registrable_scope(url_host(url))
    same = (host == allowed_host) | host.endswith(F.concat(F.lit("."), allowed_host))
    return (host != "") & same & ~has_path_term(url_path(url), BLOCKED_PATH_TERMS)


def split_terms(c: Column, fold: bool = False) -> Column:
    """Comma- or line-separated terms; with fold the first of terms alike but for case."""
    terms = F.filter(F.transform(F.split(text_of(c), "[,\n]"), lambda t: F.trim(t)), lambda t: t != "")
    if not fold:
        return terms
    return F.aggregate(
        terms,
        F.array().cast("array<string>"),
        lambda acc, t: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t))),
    )


def words(c: Column) -> Column:
    """Words of a normalised value."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def company_variants(c: Column, strict: bool = False) -> Column:
    """Sorted spellings under which a company may be mentioned, three letters or more."""
    tokens = words(normalize_text(c))
    core = F.filter(tokens, lambda t: ~t.isin(*COMPANY_NOISE))
    long = F.filter(core, lambda t: F.length(t) >= 4)
    several = (F.size(core) > 1) | ((F.size(core) == 1) & (F.length(F.get(core, F.lit(0))) >= 4))
    none = F.array().cast("array<string>")
    phrase = F.when(several, F.array(F.array_join(core, " "), F.array_join(core, ""))).otherwise(none)
    single = F.when(F.size(core) == 1, long).otherwise(none) if strict else long
    every = F.concat(F.array(F.array_join(tokens, " "), F.array_join(tokens, "")), phrase, single)
    return F.array_sort(F.array_distinct(F.filter(every, lambda v: F.length(F.replace(v, F.lit(" "), F.lit(""))) >= 3)))


def name_tokens(c: Column) -> Column:
    """N18."""
    return F.filter(words(normalize_text(c)), lambda t: ~t.isin(*HONORIFICS))


def redact(c: Column) -> Column:
    """Credentials in URLs masked."""
    return F.regexp_replace(text_of(c), r"(?i)\b((?:https?|socks[45]?)://)[^/\s@]+@", "$1***@")


def redact_map(m: Column) -> Column:
    """Values of secret keys masked, others through redact()."""
    return F.transform_values(m, lambda k, v: F.when(
        F.lower(k).rlike("password|api_?key|token|secret"), F.lit("***")).otherwise(redact(v)))


def find_profile_urls(c: Column, host: str = "linkedin.com") -> Column:
    """Profile URLs in free text, in order, canonical and distinct."""
    site = host.replace(".", r"\.")
    found = F.regexp_extract_all(text_of(c), F.lit(rf"(?i)(https?://(?:[\w.-]+\.)?{site}/in/[A-Za-z0-9_.%-]+/?)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda u: normalize_profile_url(u, host)), lambda u: u != ""))


def json_text(c: Column, keys: tuple[str, ...]) -> Column:
    """The first non-empty value of some keys of a JSON object; a plain value as it is."""
    picked = [F.get_json_object(c, f"$.{k}") for k in keys]
    plain = F.when(~F.trim(text_of(c)).startswith("{"), F.regexp_replace(F.trim(text_of(c)), '^"|"$', ""))
    return clean_spaces(F.coalesce(*[F.when(p != "", p) for p in picked], plain))


def public_url_ok(c: Column) -> Column:
    """http(s), a host, no credentials, not localhost, no private, loopback, link-local or reserved address."""
    raw = F.trim(text_of(c))
    host = url_host(raw)
    octet = r"\d{1,3}"
    closed = (
        rf"^(localhost|.*\.localhost|0\.{octet}\.{octet}\.{octet}|10\.{octet}\.{octet}\.{octet}|127\.{octet}\.{octet}\.{octet}|"
        rf"169\.254\.{octet}\.{octet}|172\.(1[6-9]|2\d|3[01])\.{octet}\.{octet}|192\.168\.{octet}\.{octet}|"
        rf"(22[4-9]|23\d|24\d|25[0-5])\.{octet}\.{octet}\.{octet})$"
    )
    credentials = raw.rlike(r"^(?i)https?://[^/?#]*@")
    return raw.rlike(r"^(?i)https?://") & (host != "") & ~credentials & ~host.rlike(closed) & ~host.startswith("[")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table for each character of a. Both sides are split
    once: in the loops they are bound values."""

    def table(chars_a: Column, chars_b: Column) -> Column:
        def step(prev: Column, x: Column) -> Column:
            return F.aggregate(
                chars_b,
                F.array(F.lit(0)),
                lambda acc, y: F.array_append(acc, F.when(
                    x == y, F.get(prev, F.size(acc) - 1) + 1
                ).otherwise(F.greatest(F.get(prev, F.size(acc)), F.element_at(acc, -1)))),
            )

        return F.element_at(F.aggregate(chars_a, F.array_repeat(F.lit(0), F.size(chars_b) + 1), step), -1)

    filled = bound(F.split(a, ""), lambda x: bound(F.split(b, ""), lambda y: table(x, y)))
    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(filled)


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (both lengths); 100 for two empty values."""

    def ratio(x: Column, y: Column) -> Column:
        total = F.length(x) + F.length(y)
        return F.when(total == 0, F.lit(100.0)).when(x == y, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(x, y) / total)

    return bound(a, lambda x: bound(b, lambda y: ratio(x, y)))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """The ratio after sorting the words."""
    return indel_ratio(F.array_join(F.array_sort(words(a)), " "), F.array_join(F.array_sort(words(b)), " "))
