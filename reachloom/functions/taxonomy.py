"""Roles, places and industries: lists that a user brings, and the rules that match text against them, as Column
expressions. The lists are settings of a run (bounded by what a person writes), so they become literals of the plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import by_size, saved
from .predicates import _has, any_of, any_term
from .text import bound, clean_spaces, normalize_text, plain_text

# Fixed values of the data rules.
ABBREVIATIONS = {
    "ceo": "chief executive officer", "cmo": "chief marketing officer", "cto": "chief technology officer",
    "cio": "chief information officer", "cfo": "chief financial officer", "coo": "chief operating officer",
    "cro": "chief revenue officer", "cpo": "chief product officer", "chro": "chief human resources officer",
    "ciso": "chief information security officer", "cdo": "chief digital officer", "cso": "chief strategy officer",
    "vp": "vice president", "svp": "senior vice president", "evp": "executive vice president",
    "md": "managing director", "gm": "general manager", "avp": "assistant vice president",
}
LEADERSHIP = ("chief", "director", "head", "lead", "leader", "manager", "president", "vice president", "vp")
CONNECTORS = ("a", "an", "and", "at", "for", "of", "the", "to")
GENERIC = ("generic_director", "generic_vp")
INDUSTRY_TERMS = {
    "bfsi": ["BFSI", "banking", "bank", "financial services", "fintech", "insurance"],
    "gcc": ["GCC", "global capability center", "global capability centre", "global competence center", "global competence centre"],
    "hr tech": ["HR Tech", "HR technology", "HR software", "human resources technology"],
    "it": ["information technology", "IT services", "software", "technology"],
    "saas": ["SaaS", "software as a service", "cloud software"],
}


def distinct_terms(terms: list[str]) -> list[str]:
    """Cleaned terms, the first of each normalised form."""
    out: dict[str, str] = {}
    for t in terms:
        t = " ".join(str(t).split())
        if t:
            out.setdefault(plain_text(t), t)
    return list(out.values())


@dataclass(frozen=True)
class Entry:
    """A role or a place: its name, other spellings, and for roles what they do and how senior they are."""

    key: str
    others: tuple[str, ...] = ()
    function: str = ""
    seniority: str = "unspecified"

    @property
    def terms(self) -> list[str]:
        return distinct_terms([self.key, *self.others])


@dataclass(frozen=True)
class Taxonomy:
    """Entries in order, and spellings that users often get wrong."""

    entries: tuple[Entry, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, table: DataFrame) -> Taxonomy:
        """From a table: key, others (array), and if it has them function and seniority; in the order of seq."""
        rows = [r.asDict() for r in table.orderBy("seq").collect()]  # a person's list
        return cls(tuple(Entry(r["key"], tuple(r["others"] or ()), r.get("function") or plain_text(r["key"]), r.get("seniority") or "unspecified") for r in rows))

    def find(self, value: str) -> Entry:
        """The entry of that name, else the first with that spelling, else one of its own."""
        wanted = plain_text(self.aliases.get(plain_text(value), value))
        for e in self.entries:
            if plain_text(e.key) == wanted:
                return e
        for e in self.entries:
            if wanted in map(plain_text, e.terms):
                return e
        clean = " ".join(value.split())
        return Entry(clean, (), plain_text(clean))


def role_match_strength(designation: Column, role: str, taxonomy: Taxonomy) -> Column:
    """3 if a spelling of the role occurs (a short unknown acronym only as the whole text or beside a word of
    leadership), 2 if a role of the same seniority and function does, else 0."""
    wanted, asked = taxonomy.find(role), plain_text(role)

    def strength(t: Column) -> Column:
        occurs = lambda terms: any_of([_has(t, plain_text(x)) for x in terms])
        exact = occurs(wanted.terms)
        if wanted.seniority == "unspecified" and " " not in asked and len(asked) <= 3:
            exact = exact & ((t == asked) | occurs(LEADERSHIP))
        out = F.when(exact, F.lit(3))
        if wanted.seniority != "unspecified":
            alike = [
                e for e in taxonomy.entries
                if e.seniority == wanted.seniority and (e.function == wanted.function or wanted.function in GENERIC)
            ]
            near = any_of([occurs(e.terms) for e in alike])
            if wanted.function == "generic_director" and "senior" in asked:
                near = near & (t.contains("senior") | t.startswith("svp "))
            out = out.when(near, F.lit(2))
        return out.otherwise(F.lit(0))

    return bound(normalize_text(designation), strength)


def role_matches(designation: Column, roles: list[str], taxonomy: Taxonomy) -> Column:
    """Any requested role; generic seniorities count only where nothing more specific is asked for."""
    if not roles:
        return F.lit(True)
    specific = [r for r in roles if taxonomy.find(r).function not in GENERIC] or roles
    return any_of([role_match_strength(designation, r, taxonomy) > 0 for r in specific])


def expand_role_terms(roles: list[str]) -> list[str]:
    """Abbreviations and their long forms, also inside phrases; each once, in order."""
    out: dict[str, None] = {}
    for role in roles:
        norm, forms = plain_text(role), [role]
        for short, full in ABBREVIATIONS.items():
            if norm in (short, full):
                forms = [short, full]
                break
            if short in norm.split():
                forms += [" ".join(v if w == short else w for w in norm.split()) for v in (short, full)]
        out.update(dict.fromkeys(forms))
    return list(out)


def expanded_roles(roles: Column) -> Column:
    """N22 for a column of role arrays: expand_role_terms() of each row."""

    def forms(role: Column) -> Column:
        def of(norm: Column) -> Column:
            whole = [F.when(norm.isin(short, full), F.array(F.lit(short), F.lit(full))) for short, full in ABBREVIATIONS.items()]
            swap = lambda short, to: F.array_join(F.transform(F.split(norm, " "), lambda w: F.when(w == short, F.lit(to)).otherwise(w)), " ")
            inside = [F.when(_has(norm, short), F.array(swap(short, short), swap(short, full))) for short, full in ABBREVIATIONS.items()]
            return F.coalesce(*whole, F.concat(F.array(role), F.flatten(F.filter(F.array(*inside), lambda x: x.isNotNull()))))

        return bound(normalize_text(role), of)

    return F.array_distinct(F.flatten(F.transform(roles, forms)))


def role_in_title(title: Column, body: Column, roles: list[str]) -> Column:
    """An expanded role in the title or the first 120 characters of the body, or all of its telling words there
    in any order."""
    if not roles:
        return F.lit(True)
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 120))
    expanded = expand_role_terms(roles)

    def there(t: Column) -> Column:
        tests = [_has(t, plain_text(r)) for r in expanded]
        for r in expanded:
            words = [w for w in plain_text(r).split() if w not in CONNECTORS]
            if len(words) >= 2:
                all_words = F.lit(True)
                for w in words:
                    all_words = all_words & _has(t, w)
                tests.append(all_words)
        return any_of(tests)

    return bound(normalize_text(text), there)


def first_place(text: Column, places: list[str], taxonomy: Taxonomy) -> Column:
    """The name of the first requested place of which a spelling occurs, else empty."""
    if not places:
        return F.lit("")
    found = [taxonomy.find(p) for p in distinct_terms(places)]
    return bound(normalize_text(text), lambda t: F.coalesce(
        *[F.when(any_of([_has(t, plain_text(x)) for x in e.terms]), F.lit(e.key)) for e in found], F.lit("")))


def location_match(text: Column, places: list[str], taxonomy: Taxonomy) -> Column:
    """The requested place that a "Location:" field names, else the first within 1,400 characters; "Not requested"
    without a request."""
    if not places:
        return F.lit("Not requested")

    def match(t: Column) -> Column:
        given = F.trim(F.regexp_extract(t, r"(?i)\bLocation\s*:\s*([^·•|\n]{2,90})", 1))
        named = F.when(given != "", first_place(given, places, taxonomy)).otherwise("")
        return F.coalesce(F.when(named != "", named), first_place(F.substring(t, 1, 1400), places, taxonomy))

    return bound(clean_spaces(text), match)


def industry_match(evidence: Column, industries: list[str]) -> Column:
    """Any term of any requested industry; an industry without a list stands for itself."""
    if not industries:
        return F.lit(True)
    terms = [t for i in industries for t in INDUSTRY_TERMS.get(plain_text(i), [i])]
    return any_term(evidence, terms)


#: Lengths of the pieces by which phrases are found; a phrase has the greatest that fits it.
GRAMS = (2, 4, 8)


def _grams(squeezed: Column, q: int) -> Column:
    """The different pieces of q characters of a text of letters and digits, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(squeezed, F.lit(f"(?=(.{{{q}}}))")))


def phrase_hits(normal: DataFrame, key: str, phrases: DataFrame) -> DataFrame:
    """key and term of the rows (key, __text) that hold a phrase (term, __t). Blanks don't count on either side, so a phrase
    is a piece of the text without blanks. Of a phrase's pieces of q characters the one in the fewest rows is its key; rows
    that have it are compared with the phrase, and no others."""
    squeezed = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    asked = phrases.select("term", squeezed("__t").alias("__p"))
    size = F.length("__p")
    asked = asked.withColumn("__q", F.greatest(*[F.when(size >= q, q).otherwise(0) for q in GRAMS])).where("__q > 0")
    used = [r["__q"] for r in asked.select("__q").distinct().collect()]  # three at most
    own = F.coalesce(*[F.when(F.col("__q") == q, _grams(F.col("__p"), q)) for q in GRAMS])
    pieces = asked.select("term", "__p", F.explode(own).alias("__g"))
    texts = normal.select(key, squeezed("__text").alias("__s"))
    lists = F.concat(*[_grams(F.col("__s"), q) for q in used]) if used else F.array().cast("array<string>")
    there = texts.select(key, F.explode(lists).alias("__g")).join(by_size(saved(pieces.select("__g").distinct(), "pieces")), "__g")
    there = saved(there, "grams")  # what rows have of all phrases' pieces
    counts = there.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    # a piece that no row has makes a phrase's count 0: it is nowhere
    best = pieces.join(counts.hint("merge"), "__g", "left").groupBy("term", "__p").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__g")).alias("__b"))
    best = saved(best.where("__b.n > 0").select("term", "__p", F.col("__b.__g").alias("__g")), "best")
    candidates = there.join(by_size(best), "__g").select(key, "term", "__p")
    return candidates.hint("merge").join(texts, key).where(F.contains("__s", F.col("__p"))).select(key, "term").distinct()


def term_hits(rows: DataFrame, key: str, text: str, terms: DataFrame, most_phrases: int | None = None) -> DataFrame:
    """Key and term of every row whose text has the term (P01), for rows and term tables of any size. Keys are different.
    most_phrases was the size of a pass; there is one pass now, and callers may still name it.

    Terms of one word meet the rows' distinct words by an equi-join, phrases by their rarest piece (phrase_hits).
    """
    asked = saved(terms.select("term", normalize_text(F.col("term")).alias("__t")).where("__t != ''").distinct(), "terms")
    normal = saved(rows.select(key, normalize_text(F.col(text)).alias("__text")), "texts")
    words = normal.select(key, F.explode(F.array_distinct(F.split("__text", " "))).alias("__t"))
    found = words.join(by_size(asked.where("NOT contains(__t, ' ')")), "__t").select(key, "term")
    return found.unionByName(phrase_hits(normal, key, asked.where("contains(__t, ' ')")))
