"""Scores and gates of leads: weighted lookups, export readiness, matches by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import any_term
from ..functions.taxonomy import role_in_title
from ..functions.text import bound, normalize_profile_url, normalize_text, text_of, words
from .signals import assess_signal, business_model, gcc_terms

# Fixed values of the data rules.
SENIORITY = {
    "CEO": 100, "MD": 100, "Co-Founder & CEO": 100, "Founder & CEO": 100, "CTO": 95, "CMO": 95, "CIO": 95, "CDO": 95, "CISO": 93, "CFO": 93,
    "CPO": 90, "CCO": 90, "CGO": 90, "CDO/CIO": 95, "Co-Founder & CTO": 90, "Co-Founder & COO": 88, "COO": 88, "President": 92,
    "Executive Chairman": 92, "Joint MD": 90, "SVP": 80, "EVP": 82, "VP": 75, "AVP": 68, "Director": 65, "Senior Director": 70,
    "Executive Director": 72, "GM": 62, "General Manager": 62, "Country Head": 70, "BU Head": 65, "Head of Department": 60,
    "Head – Marketing": 60, "Head – Digital": 60, "Managing Director": 98,
}
INDUSTRY = {
    "FinTech": 95, "SaaS": 92, "AI/ML": 95, "Cybersecurity": 90, "Cloud/DevOps": 88, "Enterprise Software": 88, "E-Commerce": 85,
    "Healthcare/HealthTech": 82, "EdTech": 78, "Logistics": 75, "Manufacturing": 72, "Retail": 70, "Media/AdTech": 75, "BFSI": 90,
    "Payments": 92, "Automotive": 68, "Consumer Goods": 65, "Energy": 68, "Space Tech": 80,
}
COMPANY_SIZE = {
    "Unicorn (>$1B)": 100, "Enterprise (>10K employees)": 95, "Large Enterprise (5K-10K)": 88, "Mid-Market (500-5K)": 75,
    "Growth Stage (100-500)": 60, "Early Stage (<100)": 40,
}
NO_VALUE = ("", "unknown", "none", "nan", "na", "n a", "null")
HIRING = r"(?i)\b(?:i(?:'m| am)\s+hiring|hiring|looking for|job opening|show more|posted by)\b"
CUT_COMPANY = (r"(?i)(?:\bat\b|@)\s*$|\b(?:seeking|looking|hiring|searching|wanted|join|apply|opportunity|openings?|vacancies?|the|a|an|for|to)\s*$"
               r"|\b(?:show more|one of the|i lead|i oversee|posted by|professional community)\b")  # fmt: skip
WEIGHTS = {"role": 12, "location": 10, "industry": 5, "custom": 8, "company_known": 2, "business_model": 6}


def looked_up(value: Column, table: dict[str, int], default: int) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(known[value], F.lit(default))


def composite_lead_scores(df: DataFrame, seniority=SENIORITY, industry=INDUSTRY, size=COMPANY_SIZE) -> DataFrame:
    """Df with event_invitation, dm, sales, net, partnership and overall. Needs seniority, industry, company_stage,
    speaker, podcast, awards, funding, ai_signals. Halves are rounded to even."""
    s, i, c = looked_up(F.col("seniority"), seniority, 60), looked_up(F.col("industry"), industry, 65), looked_up(F.col("company_stage"), size, 60)
    yes = lambda x, n: F.when(x, n).otherwise(0)
    e = F.least(F.lit(100), 15 + yes(F.col("speaker") == "Yes", 40) + yes(F.col("podcast") == "Yes", 20) + yes(~text_of(F.col("awards")).isin("None", ""), 25))
    b = F.least(F.lit(100), 30 + yes(~text_of(F.col("funding")).isin("", "N/A", "Bootstrapped"), 30)
                + F.when(F.col("ai_signals") == "High", 25).when(F.col("ai_signals") == "Medium", 15).otherwise(0))
    rounded = lambda x: F.bround(x).cast("int")
    made = df.withColumns({"__s": s, "__i": i, "__c": c, "event_invitation": e, "__b": b})
    s, i, c, e, b = (F.col(x) for x in ("__s", "__i", "__c", "event_invitation", "__b"))
    made = made.withColumns({
        "dm": rounded(s * 0.35 + i * 0.20 + c * 0.25 + e * 0.10 + b * 0.10), "sales": rounded(c * 0.40 + s * 0.30 + b * 0.30),
        "net": rounded(s * 0.30 + e * 0.40 + i * 0.15 + c * 0.15), "partnership": rounded(s * 0.25 + i * 0.25 + c * 0.25 + e * 0.25)})
    overall = rounded(F.col("dm") * 0.35 + F.col("sales") * 0.30 + F.col("net") * 0.20 + F.col("event_invitation") * 0.15)
    return made.withColumn("overall", overall).drop("__s", "__i", "__c", "__b")


def export_ready(name: Column, company: Column, url: Column, designation: Column | None = None) -> Column:
    """Name, company and profile are there and look like such; so does the designation, if one is asked for."""
    n, c = normalize_text(name), normalize_text(company)
    ok = bound(n, lambda k: ~k.isin(*NO_VALUE) & (F.size(words(k)) <= 8)) & ~text_of(name).rlike(r"\d|@")
    ok = ok & bound(c, lambda k: ~k.isin(*NO_VALUE, "linkedin", "professional profile", "linkedin profile") & (F.size(words(k)) <= 12))
    ok = ok & ~F.trim(text_of(company)).rlike(CUT_COMPANY) & (normalize_profile_url(url) != "")
    if designation is not None:
        ok = ok & bound(normalize_text(designation), lambda k: ~k.isin(*NO_VALUE) & (F.size(words(k)) <= 20)) & ~text_of(designation).rlike(HIRING)
    return ok


def category_match(df: DataFrame, key: str, texts: dict[str, list[str]], criteria: dict[str, list[str]], model: str = "Any", gcc_only: bool = False) -> DataFrame:
    """Key, match_score (of 8 categories) and every: all categories hold, in each of them any term does. texts:
    category -> columns (role, location, industry, signal, custom, organization); criteria: category -> terms, of which
    signal's are words that select signals. A category without terms holds."""
    joined = lambda c: F.concat_ws(" ", *[F.nullif(text_of(F.col(x)), F.lit("")) for x in texts.get(c, [])])
    df = df.select("*", *[joined(c).alias(f"__{c}") for c in ("role", "location", "industry", "signal", "custom", "organization")])
    hits = [any_term(F.col(f"__{c}"), criteria[c]) if criteria.get(c) else F.lit(True) for c in ("role", "location", "industry", "custom", "organization")]
    hits.append(business_model(F.col("__industry"), F.col("__custom"), model).matched)
    hits.append(F.size(gcc_terms(F.concat_ws(" ", "__industry", "__custom"))) > 0 if gcc_only else F.lit(True))
    if criteria.get("signal"):
        rows = df.select(key, F.col("__role").alias("title"), F.col("__signal").alias("body"), F.lit("").alias("person"))
        found = assess_signal(rows, key, criteria["signal"]).select(F.col(key).alias("__key"), F.col("selected_match").alias("__hit"))
        df = df.join(found, F.col(key) == F.col("__key"), "left")
        hits.append(F.coalesce("__hit", F.lit(False)))
    else:
        hits.append(F.lit(True))
    score = sum((h.cast("int") for h in hits), F.lit(0))
    return df.select(key, score.alias("match_score"), (score == len(hits)).alias("every"))


def evaluate(df: DataFrame, key: str, roles: list[str], locations: list[str], industries: list[str] = (), signals: list[str] = (),
             custom: list[str] = (), organizations: list[str] = (), model: str = "Any", gcc_only: bool = False) -> DataFrame:
    """Key, hard (role, location and organisation), strict (hard, and industry, signal, custom terms, business model
    and capability centre, each with evidence) and score. Needs designation, company, location (the row's location
    evidence), company_evidence, person_evidence, name."""
    proof = F.concat_ws(" ", F.nullif(text_of(F.col("company")), F.lit("")), F.nullif(text_of(F.col("company_evidence")), F.lit("")))
    given = normalize_text(F.col("company_evidence")) != ""
    signal = assess_signal(df.select(key, F.lit("").alias("title"), F.col("person_evidence").alias("body"), F.col("name").alias("person")), key, list(signals))
    signal = signal.select(F.col(key).alias("__key"), F.col("score").alias("__score"), F.col("selected_match").alias("__signal"))
    made = df.join(signal, F.col(key) == F.col("__key")).withColumn("__business", business_model(F.col("company"), proof, model))
    asked = model.strip().lower() not in ("", "any")
    role = role_in_title(F.col("designation"), F.lit(""), list(roles))
    place = any_term(F.col("location"), list(locations)) if locations else F.lit(True)
    organization = any_term(F.col("company"), list(organizations)) if organizations else F.lit(True)
    industry = given & any_term(proof, list(industries)) if industries else F.lit(True)
    own = given & any_term(proof, list(custom)) if custom else F.lit(True)
    told = (normalize_text(F.col("person_evidence")) != "") & F.col("__signal") if signals else F.lit(True)
    business = F.col("__business.matched") & (given if asked else F.lit(True))
    gcc = given & (F.size(gcc_terms(proof)) > 0) if gcc_only else F.lit(True)
    hard = role & place & organization
    points = lambda c, n: F.when(c, WEIGHTS[n]).otherwise(0)
    score = F.col("__score") + points(role, "role") + points(place, "location")
    score = score + (points(industry, "industry") if industries else 0)
    terms = (own if custom else F.lit(False)) | (organization if organizations else F.lit(False))
    score = score + points(terms, "custom") + points(~normalize_text(F.col("company")).isin("", "unknown"), "company_known")
    score = score + (points(F.col("__business.matched"), "business_model") if asked else 0)
    return made.select(key, hard.alias("hard"), (hard & industry & told & own & business & gcc).alias("strict"), F.greatest(F.lit(50), F.least(F.lit(99), score)).alias("score"))
