"""Predicates over normalised text, companies, names and roles, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, clean_spaces, company_variants, name_tokens, normalize_text, plain_text, text_of, words

# Fixed values of the data rules.
INVALID_NAMES = ("new cio", "new cdo", "new cto", "linkedin member", "linkedin profile", "professional profile", "unknown")
BAD_COMPANY_MARKERS = ("500 connections", "500+ connections", "view ", "professional community", "linkedin")
BAD_DESIGNATION_MARKERS = (
    "responsible for driving", "looking for", "hiring", "job opening", "show more", "posted by", "professional community",
)
B2B_TERMS = (
    "b2b", "enterprise", "business customers", "merchant", "api", "platform", "saas", "bank partners", "corporate",
    "payments infrastructure",
)
B2C_TERMS = ("consumer", "customers", "users", "retail")
ROLE_STOP_WORDS = ("a", "an", "and", "at", "for", "global", "in", "of", "on", "senior", "the", "to")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _has(text: Column, term: Column | str) -> Column:
    """P01 on a normalised text: a term of several words as a substring (also without spaces), one word as a word."""
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    if isinstance(term, str):
        if " " in term:
            return text.contains(term) | squeeze(text).contains(term.replace(" ", ""))
        return F.lit(False) if not term else padded(text).contains(f" {term} ")
    several = F.contains(text, term) | F.contains(squeeze(text), squeeze(term))
    one = F.contains(padded(text), padded(term))
    return F.when((text == "") | (term == ""), F.lit(False)).when(term.contains(" "), several).otherwise(one)


def term_in_text(text: Column, term: Column | str) -> Column:
    """Both sides normalised."""
    if isinstance(term, str):
        return bound(normalize_text(text), lambda t: _has(t, plain_text(term)))
    return bound(normalize_text(text), lambda t: bound(normalize_text(term), lambda w: _has(t, w)))


def matching_terms(text: Column, terms: list[str]) -> Column:
    """The terms that occur, in their order."""
    return bound(normalize_text(text), lambda t: F.array_compact(F.array(*[F.when(_has(t, plain_text(x)), F.lit(x)) for x in terms])))


def any_term(text: Column, terms: list[str]) -> Column:
    return bound(normalize_text(text), lambda t: any_of([_has(t, plain_text(x)) for x in terms]))


def all_terms(text: Column, terms: list[str]) -> Column:
    return bound(normalize_text(text), lambda t: reduce(lambda a, b: a & b, [_has(t, plain_text(x)) for x in terms]))


def company_match_strength(actual: Column, requested: Column) -> Column:
    """3 for equal names, 2 for a shared spelling, else 0."""
    a, b = normalize_text(actual), normalize_text(requested)
    return (
        F.when((a == "") | (b == ""), F.lit(0))
        .when(a == b, F.lit(3))
        .when(F.arrays_overlap(company_variants(actual), company_variants(requested)), F.lit(2))
        .otherwise(F.lit(0))
    )


def business_model_match(text: Column, model: Column) -> Column:
    """P10: B2B and B2C by their terms; anything else always."""
    wanted = normalize_text(model)
    return (
        F.when(wanted.isin("b2b only", "b2b"), any_term(text, list(B2B_TERMS)))
        .when(wanted.isin("b2c only", "b2c"), any_term(text, list(B2C_TERMS)))
        .otherwise(F.lit(True))
    )


def clean_identity(name: Column, designation: Column, company: Column, least: int = 2, most: int = 6) -> Column:
    """Plausible name, designation and company."""
    n, d, c = clean_spaces(name), clean_spaces(designation), clean_spaces(company)
    name_key, role_key, company_key = normalize_text(n), normalize_text(d), normalize_text(c)
    return (
        ~name_key.isin("", *INVALID_NAMES)
        & F.size(words(name_key)).between(least, most)
        & ~n.rlike(r"\d|@")
        & (role_key != "")
        & (F.size(words(role_key)) <= 18)
        & ~any_of([F.lower(d).contains(m) for m in BAD_DESIGNATION_MARKERS])
        & (F.size(words(company_key)) <= 10)
        & ~any_of([F.lower(c).contains(m) for m in BAD_COMPANY_MARKERS])
    )


def is_active(flag: Column, status: Column) -> Column:
    """False-like flags and closed states are inactive."""
    off = F.lower(F.trim(text_of(flag))).isin("false", "0", "no", "off")
    closed = F.lower(F.trim(text_of(status))).isin("inactive", "draft", "disabled", "hidden", "deleted")
    return ~off & ~closed


def designation_overlap(designation: Column, text: Column) -> Column:
    """At least two (of one: one) and half of the telling words occur."""
    tokens = F.filter(words(normalize_text(designation)), lambda t: ~t.isin(*ROLE_STOP_WORDS) & (F.length(t) > 1))
    there = words(normalize_text(text))
    hits = F.size(F.filter(tokens, lambda t: F.array_contains(there, t)))
    needed = F.when(F.size(tokens) == 1, 1).otherwise(2)
    return F.when(F.size(tokens) == 0, F.lit(False)).otherwise((hits >= needed) & (hits * 2 >= F.size(tokens)))


def name_score(a: Column, b: Column) -> Column:
    """0.6 for equal names, 0.5 for alike ones, else 0."""
    x, y = name_tokens(a), name_tokens(b)
    last_x, last_y = F.element_at(x, -1), F.element_at(y, -1)
    lasts = last_x.startswith(last_y) | last_y.startswith(last_x)
    alike = F.forall(
        F.zip_with(x, y, lambda p, q: (p == q) | ((F.length(p) == 1) & q.startswith(p)) | ((F.length(q) == 1) & p.startswith(q))),
        lambda v: F.coalesce(v, F.lit(False)),
    )
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_distinct(x)), F.lit(1))
    return (
        F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0))
        .when(x == y, F.lit(0.6))
        .when(~lasts, F.lit(0.0))
        .when(((F.size(x) == F.size(y)) & alike) | (share >= 0.8), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that holds, else empty."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in checks], F.lit(""))
