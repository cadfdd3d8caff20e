"""Search results as candidates: headline fields, embedded records, cards of a result page.

All rules are Column expressions; text is read whole unless a rule names a length. Result pages are element tables (X00),
and what stands in a card comes from interval joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, clean_spaces, normalize_profile_url, normalize_text, text_of, unwrap_redirect, words
from .intervals import text_within, within

# Fixed values of the data rules.
EDGES = " -–—|·•"
DASHES = r"\s+[-–—]\s+"
#: A word can't begin inside another one, in any script.
BEGIN, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
VALUE = r"([^·•|\n]{2,%d})"
CURRENT = (rf"(?i){BEGIN}Current\s*:\s*" + VALUE % 160, rf"(?i){BEGIN}Currently\s+(?:serving|working)\s+as\s+" + VALUE % 160)
ROLE_AT = r"(.{2,100}?)\s+(?:at|@)\s*([A-Za-z0-9&.,' /()_-]{2,100})"
NEXT_PERSON = r"(?<=\.)\s+(?=[A-Z][A-Za-z.'’-]+(?:\s+[A-Z][A-Za-z.'’-]+){1,4}\s+[-–—]\s+)"
#: An embedded record ends before a line that closes it, if another record or nothing follows.
RECORD_END = r"(?is)(?=\n\s*\}\s*,?\s*(?:\"https?://|$))"
RECORD = r"(?is)\"(https?://(?:www\.)?linkedin\.com/in/[^\"]+)\"\s*:\s*\{(.*)$"
RESULT_CARDS = (("li", "b_algo", ""), ("article", "", ""), ("div", "", "result"))


def _fragment(c: Column) -> Column:
    return clean_spaces(F.btrim(text_of(c), F.lit(EDGES)))


def clean_name(c: Column) -> Column:
    return clean_spaces(F.regexp_replace(_fragment(c), rf"(?i){BEGIN}(?:LinkedIn|Profile){END}.*$", ""))


def clean_designation(c: Column) -> Column:
    bare = F.regexp_replace(_fragment(c), r"(?i)^(?:as|currently)\s+", "")
    return clean_spaces(F.regexp_replace(bare, r"(?is)\s+Experience\s*:.*$", ""))


def clean_company(c: Column) -> Column:
    bare = F.regexp_replace(_fragment(c), rf"(?is){BEGIN}(?:Ex|Formerly|Location|Education){END}\s*:?.*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)[·•|].*$", ""), r"(?i)^at\s+", "")
    return clean_spaces(F.regexp_replace(bare, r"\s*,\s*$", ""))


def role_company(c: Column) -> Column:
    """"role at company" as a structure of both, empty where the value doesn't say so."""
    return F.struct(
        clean_designation(F.regexp_extract(c, ROLE_AT, 1)).alias("role"), clean_company(F.regexp_extract(c, ROLE_AT, 2)).alias("company")
    )


def parse_profile_fields(title: Column, body: Column) -> Column:
    """Name, designation and company of a result's headline, with what its body says of them.

    The headline is split at spaced dashes (else at bars). The first part is the name; the first other part that reads
    "role at company" gives both, else the second and third part. The body's current role counts if it has more words,
    its current company always; its experience, title and company fields fill what is still empty. Nothing known: Unknown
    (an empty designation).
    """
    body = text_of(body)
    bare = clean_spaces(F.regexp_replace(text_of(title), r"(?i)\s*(?:\|\s*)?LinkedIn(?:\s.*)?$", ""))
    pieces = lambda t, pattern: F.filter(F.transform(F.split(t, pattern), _fragment), lambda p: p != "")
    parts = bound(bare, lambda t: bound(pieces(t, DASHES), lambda p: F.when((F.size(p) == 1) & t.contains("|"), pieces(t, r"\|")).otherwise(p)))
    said = [bound(F.regexp_extract(body, p, 1), lambda v: F.when(v != "", role_company(v))) for p in CURRENT]
    known = lambda s: F.when((s.role != "") | (s.company != ""), s)
    in_body = F.coalesce(known(said[0]), known(said[1]), F.struct(F.lit("").alias("role"), F.lit("").alias("company")))
    field = lambda pattern: F.regexp_extract(body, rf"(?i){BEGIN}{pattern}\s*:\s*" + VALUE % 100, 1)
    size = lambda c: F.size(words(normalize_text(c)))

    def made(p: Column, now: Column) -> Column:
        splits = F.filter(F.transform(F.slice(p, 2, 1_000_000), role_company), lambda s: s.role != "")
        part = lambda k: F.coalesce(F.get(p, F.lit(k)), F.lit(""))
        first = F.get(splits, F.lit(0))
        head = F.struct(
            F.when(F.size(splits) > 0, first.role).otherwise(part(1)).alias("role"),
            F.when((F.size(splits) > 0) & (first.company != ""), first.company).otherwise(part(2)).alias("company"),
        )

        def fields(h: Column) -> Column:
            role = F.when((now.role != "") & ((h.role == "") | (size(now.role) > size(h.role))), now.role).otherwise(h.role)
            company = F.when(now.company != "", now.company).otherwise(h.company)
            filled = lambda c, *more: F.coalesce(*[F.nullif(x, F.lit("")) for x in (c, *more)], F.lit(""))
            name = clean_name(F.when(F.size(p) > 0, part(0)).otherwise(F.lit("Unknown")))
            organisation = clean_company(filled(company, clean_company(field("Experience")), clean_company(field("(?:Current Company|Company)"))))
            return F.struct(
                filled(name, F.lit("Unknown")).alias("name"),
                clean_designation(filled(role, clean_designation(field("Title")))).alias("designation"),
                filled(organisation, F.lit("Unknown")).alias("company"),
            )

        return bound(head, fields)

    return bound(F.struct(parts.alias("p"), in_body.alias("b")), lambda s: made(s.p, s.b))


def own_title(c: Column) -> Column:
    """A result's title up to the site's name or an ellipsis."""
    return clean_spaces(F.regexp_replace(F.regexp_replace(clean_spaces(c), r"(?is)\|\s*LinkedIn.*$", ""), r"(?s)(?:\.{3}|…).*$", ""))


def own_body(c: Column, most: int = 1200) -> Column:
    """A result's body up to the sentence before the next person's headline, cut at `most` characters."""
    return clean_spaces(F.substring(F.get(F.split(clean_spaces(c), NEXT_PERSON, 2), F.lit(0)), 1, most))


def json_value(c: Column, key: str) -> Column:
    value = F.regexp_extract(c, rf'(?s)"{key}"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)
    return clean_spaces(F.replace(value, F.lit('\\"'), F.lit('"')))


def embedded_records(rows: DataFrame) -> DataFrame:
    """rows with pos and url, and the body of each record `"profile url": {…}` in title and body, in order of place."""
    pieces = F.split(F.concat(text_of(F.col("title")), F.lit("\n"), text_of(F.col("body"))), RECORD_END)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))  # the last one has no end
    found = rows.select("*", F.posexplode(pieces).alias("pos", "piece")).where(F.col("piece").rlike(RECORD))
    found = found.withColumn("url", normalize_profile_url(F.regexp_extract("piece", RECORD, 1)))
    return found.where("url != ''").withColumn("record", F.regexp_extract("piece", RECORD, 2)).drop("piece")


#: Places of records in one result that keep apart from the next result's.
STEP = 1 << 20


def candidates_from_results(rows: DataFrame) -> DataFrame:
    """Candidate rows (as merge_candidates takes them) of results (seq, title, body, href, source, query): one for each
    embedded record, then one for the result's own profile."""
    texts = {c: text_of(F.col(c)).alias(c) for c in ("title", "body", "href", "source", "query")}
    rows = rows.select("seq", *texts.values())
    inside = embedded_records(rows)
    given = {k: json_value(F.col("record"), k) for k in ("name", "designation", "company", "title", "body")}
    inside = inside.withColumns({f"r_{k}": v for k, v in given.items()}).withColumns({
        "r_title": F.when(F.col("r_title") != "", F.col("r_title")).otherwise(F.col("title")),
        "r_body": F.when(F.col("r_body") != "", F.col("r_body")).otherwise(F.col("body")),
    })
    wanting = (F.col("r_designation") == "") | (F.col("r_company") == "")
    inside = inside.withColumn("f", F.when(wanting, parse_profile_fields(F.col("r_title"), F.col("r_body"))))
    best = lambda k: F.coalesce(F.nullif(F.col(f"r_{k}"), F.lit("")), F.col(f"f.{k}"), F.lit(""))
    company = clean_company(best("company"))
    inside = inside.select(
        (F.col("seq") * STEP + F.col("pos")).alias("seq"), "url", clean_name(best("name")).alias("name"), clean_designation(best("designation")).alias("designation"),
        F.when(company != "", company).otherwise("Unknown").alias("company"), own_title(F.col("r_title")).alias("title"), clean_spaces(F.col("r_body")).alias("body"),
        "query", F.substring(clean_spaces(F.concat("r_title", F.lit(" "), "r_body")), 1, 1800).alias("evidence"), F.array("source").alias("sources"),
    )
    own = rows.withColumn("url", normalize_profile_url(F.col("href"))).where("url != ''")
    own = own.withColumns({"title": own_title(F.col("title")), "body": own_body(F.col("body"))})
    own = own.withColumn("f", parse_profile_fields(F.col("title"), F.col("body")))
    own = own.select(
        (F.col("seq") * STEP + (STEP - 1)).alias("seq"), "url", "f.name", "f.designation", "f.company", "title", "body", "query",
        F.substring(clean_spaces(F.concat("title", F.lit(" "), "body")), 1, 900).alias("evidence"), F.array("source").alias("sources"),
    )
    return inside.unionByName(own)


def results_from_html(nodes: DataFrame, selectors: tuple[tuple[str, str, str], ...] = RESULT_CARDS, most: int = 10) -> DataFrame:
    """page_id, rank (from 1), url, href, title, body: the first `most` different profiles of a result page (an element
    table, X00). A card is an element of a selector (tag, class, test id; empty ones don't count); a page without cards has
    its profile links for cards. Title: the link's text; body: the card's."""
    has = lambda cls: F.array_contains(F.split(F.trim("class"), r"\s+"), cls)
    fits = F.lit(False)
    for tag, cls, test in selectors:
        fits = fits | ((F.col("tag") == tag) & (has(cls) if cls else F.lit(True)) & ((F.col("testid") == test) if test else F.lit(True)))
    links = nodes.where((F.col("tag") == "a") & F.col("href").isNotNull())
    cards = nodes.where(fits).select("page_id", "node", "last", "levels")
    bare = links.where(F.col("href").contains("linkedin.com/in/")).join(cards.select("page_id").distinct(), "page_id", "left_anti")
    found = within(cards, links.select("page_id", "node", "last", "href"))
    found = found.unionByName(bare.select("page_id", F.col("node").alias("outer"), "node", "last", "levels", "href"))
    found = found.withColumn("href", unwrap_redirect(F.trim("href"))).withColumn("url", normalize_profile_url(F.col("href"))).where("url != ''")
    first = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("outer", "node"))
    found = found.withColumn("n", first).where("n = 1")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("outer", "node"))).where(F.col("rank") <= most)
    found = found.select("page_id", "rank", "url", "href", "outer", "node")
    wanted = found.select("page_id", F.col("outer").alias("node")).unionByName(found.select("page_id", "node")).distinct()
    texts = text_within(nodes, wanted)
    title, body = (texts.select("page_id", F.col("node").alias(k), F.col("text").alias(v)) for k, v in (("node", "title"), ("outer", "body")))
    full = found.join(title, ["page_id", "node"], "left").join(body, ["page_id", "outer"], "left")
    return full.select("page_id", "rank", "url", "href", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"))
