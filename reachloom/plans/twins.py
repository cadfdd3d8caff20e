"""SQL expressions for the twins: what the functions in functions/ say, in the dialect that checks them."""

from __future__ import annotations

from ..functions.predicates import BAD_COMPANY_MARKERS, BAD_DESIGNATION_MARKERS, INVALID_NAMES, ROLE_STOP_WORDS
from ..functions.text import (
    ACCENTED,
    COMPANY_NOISE,
    HONORIFICS,
    LATIN,
    LEGAL_SUFFIXES,
    MARKS,
    PLAIN,
    REGIONS,
    RESERVED_SLUGS,
    UNKNOWN_VALUES,
)


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def n08(x: str) -> str:
    return f"trim(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '\\s+', ' ', 'g'))"


def n01(x: str) -> str:
    spaced = f"translate(regexp_replace(coalesce({x}, ''), '([{LATIN}])', '\\1 ', 'g'), '{ACCENTED}', '{PLAIN}')"
    return f"trim(regexp_replace(lower(replace({spaced}, '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"


def n02(x: str) -> str:
    plain = f"regexp_replace(translate(coalesce({x}, ''), '{ACCENTED}', '{PLAIN}'), '[{MARKS}]', '', 'g')"
    return f"trim(regexp_replace(replace(lower(replace({plain}, '&', ' and ')), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def n03(x: str) -> str:
    return f"trim(regexp_replace({n02(x)}, '((^| )({'|'.join(LEGAL_SUFFIXES)}))+$', ''))"


def n04(x: str) -> str:
    v = f"lower({n08(x)})"
    return f"CASE WHEN regexp_full_match({v}, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN {v} ELSE '' END"


def n05(x: str) -> str:
    raw = n08(x)
    digits = f"regexp_replace({raw}, '\\D', '', 'g')"

    def valid(code, short, long, leads, national):
        return (f"CASE WHEN length({national}) BETWEEN {short} AND {long} AND strpos('{leads}', substr({national}, 1, 1)) > 0 "
                f"THEN '+{code}' || {national} END")  # fmt: skip

    whole = f"CASE WHEN starts_with({raw}, '00') THEN substr({digits}, 3) ELSE {digits} END"
    abroad = [f"CASE WHEN starts_with({whole}, '{r[0]}') THEN {valid(*r, f'substr({whole}, {len(r[0]) + 1})')} END" for r in REGIONS.values()]
    code, short, long, leads = REGIONS["IN"]
    home = f"regexp_replace({digits}, '^0', '')"
    local = (f"coalesce(CASE WHEN starts_with({home}, '{code}') AND length({home}) > {long} THEN "
             f"{valid(code, short, long, leads, f'substr({home}, {len(code) + 1})')} END, {valid(code, short, long, leads, home)})")  # fmt: skip
    return (f"coalesce(CASE WHEN starts_with({raw}, '+') OR starts_with({raw}, '00') THEN coalesce({', '.join(abroad)}) "
            f"ELSE {local} END, '')")  # fmt: skip


def n06(x: str, host: str = "linkedin.com") -> str:
    raw = f"trim(coalesce({x}, ''))"
    raw = f"CASE WHEN contains({raw}, '://') THEN {raw} ELSE 'https://' || regexp_replace({raw}, '^/+', '') END"
    site = host.replace(".", r"\.")
    p = rf"^[^:/?#]+://(?:[^/?#@]*@)?(?i:(?:[^/?#:@\[\]]+\.)?{site})\.*(?::\d*)?/(?i:in|mwlite/profile/in)/([^/?#]+)"
    slug = f"lower(trim(regexp_extract({raw}, '{p}', 1)))"
    return (f"CASE WHEN {slug} = '' OR {slug} IN ({quoted(RESERVED_SLUGS)}) OR length({slug}) > 100 THEN '' "
            f"ELSE 'https://www.{host}/in/' || {slug} || '/' END")  # fmt: skip


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def n14(name: str, company: str) -> str:
    n, c = n01(name), n01(company)
    bad = quoted(UNKNOWN_VALUES)
    return f"CASE WHEN {n} IN ({bad}) OR {c} IN ({bad}) THEN '' ELSE {n} || '|' || {c} END"


def n17(x: str) -> str:
    tokens = words(n01(x))
    core = f"list_filter({tokens}, lambda t: t NOT IN ({quoted(COMPANY_NOISE)}))"
    several = f"len({core}) > 1 OR (len({core}) = 1 AND length({core}[1]) >= 4)"
    every = (f"list_concat([array_to_string({tokens}, ' '), array_to_string({tokens}, '')], "
             f"list_concat(CASE WHEN {several} THEN [array_to_string({core}, ' '), array_to_string({core}, '')] ELSE [] END, "
             f"list_filter({core}, lambda t: length(t) >= 4)))")  # fmt: skip
    return f"list_sort(list_distinct(list_filter({every}, lambda v: length(replace(v, ' ', '')) >= 3)))"


def n18(x: str) -> str:
    return f"list_filter({words(n01(x))}, lambda t: t NOT IN ({quoted(HONORIFICS)}))"


def p01(text: str, term: str) -> str:
    """term is a literal, normalised here."""
    t = n01(text)
    if " " in term:
        return f"(contains({t}, '{term}') OR contains(replace({t}, ' ', ''), '{term.replace(' ', '')}'))"
    return f"contains(' ' || {t} || ' ', ' {term} ')"


def any_p01(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(p01(text, t) for t in terms) + ")"


def p11(name: str, role: str, company: str, least: int = 2, most: int = 6) -> str:
    n, d, c = n08(name), n08(role), n08(company)
    marks = lambda x, ms: "(" + " OR ".join(f"contains(lower({x}), '{m}')" for m in ms) + ")"
    return (f"({n01(name)} NOT IN ('', {quoted(INVALID_NAMES)}) AND len({words(n01(name))}) BETWEEN {least} AND {most} "
            f"AND NOT regexp_matches({n}, '\\d|@') AND {n01(role)} <> '' AND len({words(n01(role))}) <= 18 "
            f"AND NOT {marks(d, BAD_DESIGNATION_MARKERS)} AND len({words(n01(company))}) <= 10 "
            f"AND NOT {marks(c, BAD_COMPANY_MARKERS)})")  # fmt: skip


def p16(role: str, text: str) -> str:
    tokens = f"list_filter({words(n01(role))}, lambda t: t NOT IN ({quoted(ROLE_STOP_WORDS)}) AND length(t) > 1)"
    hits = f"len(list_filter({tokens}, lambda t: list_contains({words(n01(text))}, t)))"
    return (f"CASE WHEN len({tokens}) = 0 THEN false ELSE {hits} >= CASE WHEN len({tokens}) = 1 THEN 1 ELSE 2 END "
            f"AND {hits} * 2 >= len({tokens}) END")  # fmt: skip


def token_sort_ratio(a: str, b: str) -> str:
    """200 * longest common subsequence / both lengths of two columns that hold sorted words."""
    chars = f"list_transform(string_split({a}, ''), lambda c: [ord(c)])"
    row = f"list_transform(range(length({b}) + 1), lambda z: 0)"
    step = (f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [CAST(j AS INT)]), lambda r, j: list_append(r, "
            f"CASE WHEN ord(substr({b}, j[1], 1)) = x[1] THEN acc[j[1]] + 1 ELSE greatest(acc[j[1] + 1], r[j[1]]) END), [0])")  # fmt: skip
    table = f"list_reduce({chars}, lambda acc, x: {step}, {row})"
    return f"200.0 * ({table})[length({b}) + 1] / (length({a}) + length({b}))"
