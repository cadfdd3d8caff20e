"""Contact lists: canonical records, deduplication, identity clusters, matching against history, decisions.

Strings that are unknown are empty; join keys are never empty. Order-dependent rules follow `seq`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    bound,
    indel_ratio,
    normalize_company,
    normalize_email,
    normalize_identity_text,
    normalize_phone,
    normalize_profile_url,
    text_of,
    token_sort_ratio,
    words,
)
from ..storage import saved
from .graph import components

IDENTIFIERS = ("phone", "email", "profile")

# Fixed values of the data rules: the first matching group wins, by substring of the normalised status.
STATUS_RULES = (
    ("DO_NOT_CONTACT", ("do not contact", "dnc", "unsubscribe", "blocked")),
    ("POSITIVE_RESPONSE", ("positive", "interested", "confirmed", "accepted")),
    ("NEGATIVE_RESPONSE", ("negative", "not interested", "declined", "rejected")),
    ("NO_RESPONSE", ("no response", "no reply", "unresponsive")),
    ("SAFE_OR_RECONTACT_ALLOWED", ("safe", "recontact", "reach out again", "available")),
    ("REVIEW", ("review", "check", "uncertain")),
    ("CONTACTED", ("contacted", "reached out", "emailed", "sent")),
)
CONTACTED = ("CONTACTED", "POSITIVE_RESPONSE", "NEGATIVE_RESPONSE", "NO_RESPONSE")


def canonicalize(df: DataFrame, region: str = "IN") -> DataFrame:
    """Df with record_id, normalised identity columns and the list of issues. Needs seq, source_id, full_name,
    company, email, phone, profile_url."""
    made = df.select(
        "*",
        F.concat_ws(":", "source_id", F.col("seq").cast("string")).alias("record_id"),
        normalize_identity_text(F.col("full_name")).alias("name_key"),
        normalize_company(F.col("company")).alias("company_key"),
        normalize_email(F.col("email")).alias("email_key"),
        normalize_phone(F.col("phone"), region).alias("phone_key"),
        normalize_profile_url(F.col("profile_url")).alias("profile_key"),
    )
    given = lambda c: F.trim(text_of(F.col(c))) != ""
    weak = (F.col("email_key") == "") & (F.col("phone_key") == "") & (F.col("profile_key") == "") & (F.col("company_key") == "")
    issues = F.array_compact(F.array(
        F.when(given("email") & (F.col("email_key") == ""), F.lit("malformed_email")),
        F.when(given("phone") & (F.col("phone_key") == ""), F.lit("malformed_phone")),
        F.when(given("profile_url") & (F.col("profile_key") == ""), F.lit("invalid_profile_url")),
        F.when(weak, F.lit("weak_identity_name_only")),
    ))
    return made.withColumn("issues", issues)


def named(canonical: DataFrame) -> DataFrame:
    return canonical.where(F.col("name_key") != "")


def invalid_rows(canonical: DataFrame) -> DataFrame:
    """Rejected rows (no name) and one row for each other issue."""
    rejected = canonical.where(F.col("name_key") == "").select(
        "record_id", F.lit("missing_identity_name").alias("reason"), F.lit("REJECTED").alias("disposition"))
    warned = named(canonical).select("record_id", F.explode("issues").alias("reason"))
    warned = warned.where(F.col("reason") != "weak_identity_name_only")
    return rejected.unionByName(warned.withColumn("disposition", F.lit("PROCESSED_WITH_WARNING")))


def identity_key() -> Column:
    """The best key a record has: phone, else email, else profile, else name and company; null without any."""
    pick = lambda kind, c: F.when(F.col(c) != "", F.concat(F.lit(kind + ":"), F.col(c)))
    both = F.when((F.col("name_key") != "") & (F.col("company_key") != ""), F.concat_ws("|", F.lit("nc"), "name_key", "company_key"))
    return F.coalesce(pick("phone", "phone_key"), pick("email", "email_key"), pick("profile", "profile_key"), both)


def first_wins(canonical: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Canonical with duplicate_of (record_id of the first record with the same best key; null for firsts and for
    records without a key). Records are compared within `scope` columns."""
    df = canonical.withColumn("__key", identity_key())
    by = Window.partitionBy(*(scope or []), F.coalesce("__key", "record_id")).orderBy("seq", "record_id")
    df = df.withColumn("__first", F.first("record_id").over(by)).withColumn("__n", F.row_number().over(by))
    dup = F.when(F.col("__key").isNotNull() & (F.col("__n") > 1), F.col("__first"))
    return df.withColumn("duplicate_of", dup).drop("__key", "__first", "__n")


def identifier_rows(canonical: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each identifier that a record has: keep, kind, value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_key").alias("value")) for k in IDENTIFIERS])
    return canonical.select(*keep, F.explode(pairs).alias("i")).select(*keep, "i.kind", "i.value").where("value != ''")


def identity_links(history: DataFrame) -> DataFrame:
    """Links (a, b) from each record to the first with the same identifier, and to the first of its name and
    company unless an identifier that both have differs from that first record's."""
    ids = identifier_rows(history, ["seq"])
    firsts = ids.groupBy("kind", "value").agg(F.min("seq").alias("first"))
    strong = ids.join(firsts, ["kind", "value"]).where("seq != first").select(F.col("seq").alias("a"), F.col("first").alias("b"))
    full = history.where("name_key != '' AND company_key != ''").select("seq", "name_key", "company_key", *[f"{k}_key" for k in IDENTIFIERS])
    anchors = full.groupBy("name_key", "company_key").agg(
        F.min_by(F.struct("seq", *[f"{k}_key" for k in IDENTIFIERS]), "seq").alias("x"))
    both = full.join(anchors, ["name_key", "company_key"]).where("seq != x.seq")
    clash = F.lit(False)
    for k in IDENTIFIERS:
        mine, theirs = F.col(f"{k}_key"), F.col(f"x.{k}_key")
        clash = clash | ((mine != "") & (theirs != "") & (mine != theirs))
    return strong.unionByName(both.where(~clash).select(F.col("seq").alias("a"), F.col("x.seq").alias("b")))


def clustered(history: DataFrame) -> DataFrame:
    """history with cluster: the smallest seq that links reach."""
    found = components(identity_links(history)).select(F.col("id").alias("seq"), "component")
    return history.join(found, "seq", "left").withColumn("cluster", F.coalesce("component", "seq")).drop("component")


def status_category(status: Column) -> Column:
    """D06. "not interested" holds "interested", which comes first; kept as it is."""
    text = normalize_identity_text(status)

    def chain(t: Column) -> Column:
        out = F.when(t == "", F.lit("UNKNOWN"))
        for name, terms in STATUS_RULES:
            hit = F.lit(False)
            for term in terms:
                hit = hit | t.contains(term)
            out = out.when(hit, F.lit(name))
        return out.otherwise(F.lit("UNKNOWN"))

    return bound(text, chain)


def mapped_category(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """D06 with a user's map (raw_status, category): exact status, then its normalised form, then the rules."""
    known = [name for name, _ in STATUS_RULES] + ["UNKNOWN"]
    exact = mapping.select(F.col("raw_status").alias("__raw"), F.col("category").alias("__exact"))
    loose = mapping.select(F.col("raw_status").alias("__norm"), F.col("category").alias("__loose"))
    out = df.join(exact, F.col("status") == F.col("__raw"), "left")
    out = out.join(loose, normalize_identity_text(F.col("status")) == F.col("__norm"), "left")
    chosen = F.coalesce("__exact", "__loose")
    category = F.when(chosen.isNull(), status_category(F.col("status"))).when(chosen.isin(*known), chosen).otherwise("UNKNOWN")
    return out.withColumn("category", category).drop("__raw", "__exact", "__norm", "__loose")


def history_decision(categories: Column) -> Column:
    """D07 over a set of categories."""
    return (
        F.when(F.array_contains(categories, "DO_NOT_CONTACT"), "DO_NOT_CONTACT")
        .when(F.arrays_overlap(categories, F.array(*map(F.lit, CONTACTED))), "ALREADY_CONTACTED")
        .when((F.size(categories) > 0) & F.forall(categories, lambda c: c == "SAFE_OR_RECONTACT_ALLOWED"), "SAFE_TO_CONTACT")
        .otherwise("REVIEW_REQUIRED")
    )


def cluster_summary(history: DataFrame) -> DataFrame:
    """One row for each cluster: records, statuses' categories, decision, names."""
    return history.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("records"),
        F.collect_set(status_category(F.col("status"))).alias("categories"),
        F.collect_set("name_key").alias("names"),
    ).withColumn("history_decision", history_decision(F.col("categories")))


def match_exact(primary: DataFrame, history: DataFrame) -> DataFrame:
    """Seq, and the clusters each kind of identifier leads to."""
    theirs = identifier_rows(history, ["cluster"]).distinct()
    hits = identifier_rows(primary, ["seq"]).join(theirs, ["kind", "value"])
    sets = [F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("cluster")))).alias(f"by_{k}") for k in IDENTIFIERS]
    return hits.groupBy("seq").agg(*sets, F.sort_array(F.collect_set("cluster")).alias("clusters"))


def match_name_company(primary: DataFrame, history: DataFrame) -> DataFrame:
    """Seq and the clusters with the same name and company."""
    theirs = history.where("name_key != '' AND company_key != ''").select("name_key", "company_key", "cluster").distinct()
    return primary.join(theirs, ["name_key", "company_key"]).groupBy("seq").agg(F.sort_array(F.collect_set("cluster")).alias("clusters"))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio among the common words and each side's rest added to them."""
    x, y = F.array_sort(F.array_distinct(words(a))), F.array_sort(F.array_distinct(words(b)))
    both = F.array_join(F.array_intersect(x, y), " ")
    left, right = F.array_join(F.array_except(x, y), " "), F.array_join(F.array_except(y, x), " ")
    with_left, with_right = F.trim(F.concat_ws(" ", both, left)), F.trim(F.concat_ws(" ", both, right))
    whole = (both != "") & ((left == "") | (right == ""))
    part = F.when(both != "", F.greatest(indel_ratio(both, with_left), indel_ratio(both, with_right))).otherwise(0.0)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(whole, 100.0).otherwise(F.greatest(indel_ratio(with_left, with_right), part))


#: Names longer than this are alike in length for the keys by which pairs are found.
LONGEST_NAME = 256


def _piece_sizes(share: float) -> tuple[float, list[int], list[list[int]]]:
    """The greatest number of single-character edits for each character of a name; for each length of a name the size of
    its pieces, and the sizes that its partners' pieces have. Names are alike if the common subsequence has `share` of
    both lengths.

    An edit spoils one of a name's pieces at most, as they don't overlap; so a size fits if there are more pieces than edits.
    """
    if not 2 / 3 < share <= 1:
        raise ValueError("names that share two thirds or less can't be found by pieces")
    rate, lengths = 2 * (1 - share) / share, range(LONGEST_NAME + 2)
    own = [next((q for q in (3, 2) if n // q > math.floor(rate * n + 1e-9)), 1) for n in lengths]
    own[-1] = next((q for q in (3, 2) if LONGEST_NAME * (1 / q - rate) >= 2), 1)  # for all longer names
    least = lambda n: max(1, math.ceil(n * share / (2 - share) - 1e-9))
    most = lambda n: min(LONGEST_NAME + 1, math.floor(n * (2 - share) / share + 1e-9))
    return rate, own, [sorted(set(own[least(n) : most(n) + 1])) for n in lengths[:-1]] + [sorted(set(own[least(LONGEST_NAME + 1) :]))]


#: Characters that are counted for _letters(), and how many of each.
COUNTED, COUNTED_TIMES = "abcdefghijklmnopqrstuvwxyz0123456789 ", 3


def _letters(x: Column) -> Column:
    """How often a name has each character: a bit for each of the first three times, and the number of all others."""
    count = lambda c: F.least(F.length(x) - F.length(F.replace(x, F.lit(c), F.lit(""))), F.lit(COUNTED_TIMES))
    bits, each = [], 63 // COUNTED_TIMES
    for k in range(0, len(COUNTED), each):
        said = F.lit(0).cast("bigint")
        for n, c in enumerate(COUNTED[k : k + each]):
            said = said + F.element_at(F.array(*[F.lit(((1 << t) - 1) << (COUNTED_TIMES * n)).cast("bigint") for t in range(COUNTED_TIMES + 1)]), count(c) + 1)
        bits.append(said)
    rest = F.length(x) - sum((F.bit_count(b) for b in bits[1:]), F.bit_count(bits[0]))
    return F.struct(*[b.alias(f"b{k}") for k, b in enumerate(bits)], rest.alias("rest"))


def _letters_in_common(a: str, b: str) -> Column:
    """Upper bound of the longest common subsequence of two names by their _letters()."""
    both = [F.bit_count(F.col(f"{a}.b{k}").bitwiseAND(F.col(f"{b}.b{k}"))) for k in range(-(-len(COUNTED) // (63 // COUNTED_TIMES)))]
    return sum(both[1:], both[0]) + F.least(f"{a}.rest", f"{b}.rest")


def similar_names(left: DataFrame, right: DataFrame, least: int = 90) -> DataFrame:
    """a, b, score: all pairs of different names of two tables (columns a and b, normalised) whose rounded token-sort ratio
    is `least` or more.

    The table with fewer names cuts each of them (its words sorted) into pieces that don't overlap. For each length that
    an alike name can have, it looks for its rarest pieces in the other table's names, one more than edits can spoil. So an
    equi-join on (length, piece) finds every pair; those whose letters or edit distance exclude the ratio are dropped
    before it is computed. The other table's names are cut once and never sorted or grouped.
    """
    share = (least - 0.5) / 100
    rate, own, partners = _piece_sizes(share)
    longest = F.lit(LONGEST_NAME + 1)

    def names(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(name).where(F.col(name) != "").distinct().withColumn("x", F.array_join(F.array_sort(words(F.col(name))), " "))
        return saved(rows.withColumn("n", F.length("x")), "names")

    mine, theirs = names(left, "a"), names(right, "b")
    few, many = ("a", "b") if mine.count() <= theirs.count() else ("b", "a")
    asked, others = (mine, theirs) if few == "a" else (theirs, mine)
    asked = asked.select(few, "x", "n", F.get(F.array(*map(F.lit, own)), F.least("n", longest)).alias("q"))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / F.col("q")) - 1), lambda i: F.substring("x", (i * F.col("q") + 1).cast("int"), F.col("q")))
    asked = saved(asked.withColumn("p", cut).withColumn("l", _letters(F.col("x"))), "pieces")
    used = [r["q"] for r in asked.select("q").distinct().collect()]  # three at most
    # a name of the other table gives its pieces of the sizes that partners of its length have
    grams = lambda q: F.when(
        F.get(F.array(*[F.lit(q in qs) for qs in partners]), F.least("n", longest)) & (F.col("n") >= q),
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n") - q + 1), lambda i: F.substring("x", i, F.lit(q)))))
    given = F.array_compact(F.array(*[grams(q) for q in used])) if used else F.array().cast("array<array<string>>")
    others = others.select(F.col(many), F.col("x").alias("y"), F.col("n").alias("m"), F.flatten(given).alias("p")).where(F.size("p") > 0)
    others = saved(others.withColumn("k", _letters(F.col("y"))), "pieces")
    rarity = others.select(F.explode("p").alias("g")).join(asked.select(F.explode("p").alias("g")).distinct(), "g").groupBy("g").agg(F.count(F.lit(1)).alias("times"))
    told = asked.select(few, F.posexplode("p").alias("at", "g")).join(rarity, "g", "left").groupBy(few).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "g", "at"))).alias("p"))
    told = asked.drop("p").join(told, few)
    lengths = F.sequence(F.greatest(F.lit(1), F.least(longest, F.ceil(F.col("n") * (share / (2 - share)) - 1e-9))).cast("int"), F.least(longest, F.floor(F.col("n") * ((2 - share) / share) + 1e-9)).cast("int"))
    told = told.withColumn("length", F.explode(lengths))
    edits = F.floor((1 - share) * (F.col("n") + F.col("length")) + 1e-9)  # as many as the lengths differ by, or two, four ... more
    edits = F.when(F.col("length") < longest, edits - F.pmod(edits - F.col("n") + F.col("length"), F.lit(2))).otherwise(F.floor(F.col("n") * rate + 1e-9))
    told = told.withColumn("edits", edits.cast("int")).where((F.col("length") == longest) | (F.col("edits") >= F.abs(F.col("n") - F.col("length"))))
    told = told.withColumn("g", F.explode(F.array_distinct(F.transform(F.slice("p", F.lit(1), F.col("edits") + 1), lambda e: e.g))))
    told = saved(told.select(few, "x", "n", "l", "length", "edits", "g"), "asked")
    found = others.select(many, "y", "m", "k", F.least("m", longest).alias("length"), F.explode("p").alias("g")).join(told, ["length", "g"])
    total = F.col("n") + F.col("m")
    found = found.where((2 * F.least("n", "m") / total >= share) & (2 * _letters_in_common("l", "k") / total >= share))
    pairs = found.select("a", "b", "x", "y", "edits").distinct().where(F.expr("levenshtein(x, y, edits)") >= 0).select("a", "b")
    return pairs.withColumn("score", F.bround(token_sort_ratio(F.col("a"), F.col("b")))).where(F.col("score") >= least)


def match_fuzzy(primary: DataFrame, history: DataFrame, name_least: int = 90, company_least: int = 80, alone_least: int = 95) -> DataFrame:
    """Seq, cluster, score and both similarities of alike names at alike companies; all within two points of the best.

    A name looks at the clusters in which any record shares its last word or first letter. The best name and the best
    company are taken over all records of a cluster, each by itself. Alike names come from similar_names().
    """
    primary = saved(primary.select("seq", "name_key", "company_key"), "rest")
    mine = primary.where("name_key != ''").select("name_key", "company_key").distinct()
    last = lambda c: F.concat(F.lit("s:"), F.element_at(words(c), -1))
    head = lambda c: F.concat(F.lit("i:"), F.substring(c, 1, 1))
    both = lambda c: F.explode(F.array(last(F.col(c)), head(F.col(c)))).alias("k")
    alike = saved(similar_names(mine.select(F.col("name_key").alias("a")), history.select(F.col("name_key").alias("b")), name_least), "alike")
    alike = alike.select(F.col("a").alias("name_key"), F.col("b").alias("n"), F.col("score").alias("name_score"))
    alike = history.select(F.col("name_key").alias("n"), "cluster").join(alike, "n")
    alike = saved(alike.groupBy("name_key", "cluster").agg(F.max("name_score").alias("name_score")), "alike")
    near = saved(history.select("name_key", "company_key", "cluster").join(alike.select("cluster").distinct(), "cluster", "left_semi"), "near")  # all records of these clusters
    keys = near.where("name_key != ''").select("cluster", both("name_key")).distinct()
    seen = alike.select("name_key", "cluster", both("name_key")).join(keys, ["cluster", "k"], "left_semi").select("name_key", "cluster").distinct()
    alike = alike.join(seen, ["name_key", "cluster"])
    companies = near.where("company_key != ''").select(F.col("company_key").alias("c"), "cluster").distinct()
    company_score = F.when(
        (F.col("company_key") != "") & F.col("c").isNotNull(), F.bround(token_set_ratio(F.col("company_key"), F.col("c")))).otherwise(0.0)
    best = mine.join(alike, "name_key").join(companies, "cluster", "left").groupBy("name_key", "company_key", "cluster").agg(
        F.max("name_score").alias("name_score"), F.max(company_score).alias("company_score"))
    with_company = (F.col("company_key") != "") & (F.col("company_score") >= company_least)
    alone = (F.col("company_key") == "") & (F.col("name_score") >= alone_least)
    best = best.where(with_company | alone).withColumn(
        "score", F.when(with_company, F.bround(F.col("name_score") * 0.7 + F.col("company_score") * 0.3)).otherwise(F.col("name_score")))
    top = F.max("score").over(Window.partitionBy("name_key", "company_key"))
    best = best.withColumn("__top", top).where("__top - score <= 2").drop("__top")
    return primary.select("seq", "name_key", "company_key").join(best, ["name_key", "company_key"]).select(
        "seq", "cluster", F.col("score").cast("int").alias("score"), F.col("name_score").cast("int").alias("name_score"),
        F.col("company_score").cast("int").alias("company_score"))


def match_decisions(primary: DataFrame, history: DataFrame, fuzzy: bool = True) -> DataFrame:
    """One row for each primary record: seq, match_type, confidence, clusters, decision, confirmed.

    history is clustered. Precedence: identifiers, name and company, alike names, no match.
    """
    summary = cluster_summary(history)
    exact = saved(match_exact(primary, history), "exact").withColumn("__one", F.size("clusters") == 1)
    agree = exact.where("__one").select("seq", *[f"by_{k}" for k in IDENTIFIERS], "clusters", F.col("clusters")[0].alias("cluster"))
    agree = agree.join(primary.select("seq", "name_key"), "seq").join(summary, "cluster")
    best_name = F.array_max(F.transform("names", lambda n: token_sort_ratio(F.col("name_key"), n)))
    kind = F.when(F.size("by_phone") > 0, "EXACT_PHONE").when(F.size("by_email") > 0, "EXACT_EMAIL").otherwise("EXACT_PROFILE")
    sure = F.when(F.size("by_phone") > 0, 100).when(F.size("by_email") > 0, 99).otherwise(98)
    agree = agree.withColumn("__clash", (F.col("name_key") != "") & (best_name < 60)).select(
        "seq", kind.alias("match_type"), F.when(F.col("__clash"), 75).otherwise(sure).alias("confidence"), "clusters",
        F.when(F.col("__clash"), F.lit("REVIEW_REQUIRED")).otherwise(F.col("history_decision")).alias("decision"),
        (~F.col("__clash")).alias("confirmed"))
    split = exact.where("NOT __one").select(
        "seq", kind.alias("match_type"), F.lit(70).alias("confidence"), "clusters",
        F.lit("REVIEW_REQUIRED").alias("decision"), F.lit(False).alias("confirmed"))
    rest = primary.join(exact.select("seq"), "seq", "left_anti")
    by_name = saved(match_name_company(rest, history), "by-name")
    single = by_name.where(F.size("clusters") == 1).withColumn("cluster", F.col("clusters")[0]).join(summary, "cluster").select(
        "seq", F.lit("NAME_COMPANY_MATCH").alias("match_type"), F.lit(90).alias("confidence"), "clusters",
        F.col("history_decision").alias("decision"), F.lit(True).alias("confirmed"))
    several = by_name.where(F.size("clusters") > 1).select(
        "seq", F.lit("NAME_COMPANY_MATCH").alias("match_type"), F.lit(70).alias("confidence"), "clusters",
        F.lit("REVIEW_REQUIRED").alias("decision"), F.lit(False).alias("confirmed"))
    found = agree.unionByName(split).unionByName(single).unionByName(several)
    if fuzzy:
        left = rest.join(by_name.select("seq"), "seq", "left_anti")
        alike = match_fuzzy(left, history).groupBy("seq").agg(
            F.max("score").alias("confidence"), F.sort_array(F.collect_set("cluster")).alias("clusters")).select(
            "seq", F.lit("POSSIBLE_MATCH").alias("match_type"), "confidence", "clusters",
            F.lit("POSSIBLE_MATCH").alias("decision"), F.lit(False).alias("confirmed"))
        found = found.unionByName(alike)
    none = F.array().cast("array<bigint>")
    return primary.select("seq").join(found, "seq", "left").select(
        "seq", F.coalesce("match_type", F.lit("NO_MATCH")).alias("match_type"), F.coalesce("confidence", F.lit(0)).alias("confidence"),
        F.coalesce("clusters", none).alias("clusters"), F.coalesce("decision", F.lit("SAFE_TO_CONTACT")).alias("decision"),
        F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


def apply_review(matches: DataFrame, overrides: DataFrame, summary: DataFrame) -> DataFrame:
    """Decisions after the reviewers' actions (seq, action). Unknown actions change nothing."""
    m = matches.join(overrides.select("seq", "action"), "seq", "left")
    first = summary.select(F.col("cluster").alias("__c"), "history_decision", "categories")
    linked = m.select("seq", F.explode("clusters").alias("__c")).join(first, "__c").groupBy("seq").agg(
        history_decision(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("__decision"))
    m = m.join(linked, "seq", "left")
    confirm = (F.col("action") == "CONFIRM") & (F.size("clusters") > 0)
    safe, never = F.col("action").isin("REJECT", "MARK_SAFE"), F.col("action") == "MARK_DNC"
    return m.select(
        "seq", "match_type", "confidence", "clusters",
        F.when(confirm, F.col("__decision")).when(safe, "SAFE_TO_CONTACT").when(never, "DO_NOT_CONTACT").otherwise(F.col("decision")).alias("decision"),
        F.when(confirm, True).when(safe, False).otherwise(F.col("confirmed")).alias("confirmed"))


def run_metrics(primary: DataFrame, history: DataFrame, matches: DataFrame, duplicates: DataFrame, invalid: DataFrame) -> DataFrame:
    """(metric, value) rows."""
    confirmed = matches.where("confirmed").select(F.explode("clusters").alias("cluster")).distinct()
    unseen = history.select("cluster").distinct().join(confirmed, "cluster", "left_anti")
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = [
        count("primary_prospects", primary), count("previous_records", history), count("duplicates", duplicates),
        count("unique_people", primary.select("seq").unionByName(unseen.select(F.col("cluster").alias("seq")))),
        count("common_people", matches.where("confirmed")), count("invalid_rows", invalid.where("disposition = 'REJECTED'")),
    ]
    names = {"SAFE_TO_CONTACT": "safe_to_contact", "ALREADY_CONTACTED": "already_contacted", "DO_NOT_CONTACT": "do_not_contact",
             "POSSIBLE_MATCH": "possible_matches", "REVIEW_REQUIRED": "review_required"}
    parts += [count(name, matches.where(F.col("decision") == d)) for d, name in names.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def combined_master(primary: DataFrame, history: DataFrame, matches: DataFrame) -> DataFrame:
    """Every primary record (BOTH or PRIMARY_ONLY) and one row for each history cluster without a confirmed member."""
    per = history.groupBy("cluster").agg(
        F.min_by("full_name", "seq").alias("full_name"), F.min_by("company", "seq").alias("company"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") != "", F.struct("seq", "status")))), lambda x: x.status), " | ").alias("statuses"),
        F.count(F.lit(1)).alias("interactions"))
    linked = matches.where("confirmed").select("seq", F.explode("clusters").alias("cluster"))
    own = primary.select("seq", "full_name", "company").join(
        linked.join(per.select("cluster", "statuses", "interactions"), "cluster").groupBy("seq").agg(
            F.array_join(F.array_sort(F.collect_list("statuses")), " | ").alias("statuses"), F.sum("interactions").alias("interactions")), "seq", "left")
    own = own.select(
        F.concat(F.lit("p"), F.col("seq").cast("string")).alias("person"), "full_name", "company",
        F.when(F.col("interactions").isNotNull(), "BOTH").otherwise("PRIMARY_ONLY").alias("presence"),
        F.coalesce("statuses", F.lit("")).alias("statuses"), F.coalesce("interactions", F.lit(0)).cast("long").alias("interactions"))
    only = per.join(linked.select("cluster").distinct(), "cluster", "left_anti").select(
        F.concat(F.lit("h"), F.col("cluster").cast("string")).alias("person"), "full_name", "company",
        F.lit("PREVIOUS_ONLY").alias("presence"), "statuses", F.col("interactions").cast("long").alias("interactions"))
    return own.unionByName(only)


def prepared(primary: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Canonical inputs of a comparison: kept primaries, clustered history, primary duplicates, invalid rows."""
    canonical = saved(canonicalize(primary), "primary")
    flagged = first_wins(named(canonical))
    old = saved(clustered(saved(named(canonicalize(history)), "history")), "history-clusters")
    return flagged.where("duplicate_of IS NULL"), old, flagged.where("duplicate_of IS NOT NULL"), invalid_rows(canonical)
