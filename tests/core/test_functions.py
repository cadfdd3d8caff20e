"""Scalar functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from reachloom.functions import predicates as P
from reachloom.functions import taxonomy as X
from reachloom.functions import text as N

col = F.col


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (N.normalize_text, "Ángel & Co–Op", "a ngel and co op"),
        (N.normalize_text, None, ""),
        (N.normalize_identity_text, "Ángel  STRASSE-ß", "angel strasse ss"),
        (N.normalize_company, "Acme Pvt Ltd", "acme"),
        (N.normalize_company, "Limited", ""),
        (N.normalize_company, "Acme Private Limited LLP", "acme"),
        (N.normalize_email, "  A.B@Example.COM ", "a.b@example.com"),
        (N.normalize_email, "a@@b.c", ""),
        (N.normalize_phone, "+91 98765 43210", "+919876543210"),
        (N.normalize_phone, "098765-43210", "+919876543210"),
        (N.normalize_phone, "12-34", ""),
        (N.normalize_public_phone, "tel%20+44%2020%207946%200018 ext 5".replace("tel%20", ""), "+442079460018"),
        (N.normalize_public_phone, "20240131", ""),
        (N.normalize_public_phone, "11111111", ""),
        (N.normalize_profile_url, "in.linkedin.com/in/Some-One?x=1", "https://www.linkedin.com/in/some-one/"),
        (N.normalize_profile_url, "https://linkedin.com/mwlite/profile/in/a b/", "https://www.linkedin.com/in/a b/"),
        (N.normalize_profile_url, "https://www.linkedin.com/in/jobs/", ""),
        (N.normalize_profile_url, "http://[2001:db8::1]", ""),
        (N.profile_id, "linkedin.com/in/Some-One/", "some-one"),
        (N.unwrap_redirect, "https://search.example/url?q=https%3A%2F%2Fa.example%2Fx&z=1", "https://a.example/x"),
        (N.unwrap_redirect, "https://s.example/?uddg=https%3A%2F%2Fb.example", "https://b.example"),
        (N.unwrap_redirect, "https://s.example/ck?u=a1aHR0cHM6Ly9jLmV4YW1wbGUv", "https://c.example/"),
        (N.unwrap_redirect, "https://s.example/ck?u=a1%%%", "https://s.example/ck?u=a1%%%"),
        (N.template_key, " 1st Name ", "field_1st_name"),
        (N.template_key, "--", "field"),
        (N.canonical_url, "Example.com//a//b?q#f", "https://example.com/a/b"),
        (N.redact, "http://u:p@h/x", "http://***@h/x"),
        (N.public_url_ok, "http://10.0.0.1/", False),
        (N.public_url_ok, "https://example.com/", True),
        (N.public_url_ok, "https://u:p@example.com/", False),
        (N.source_family, "Google Web", "google"),
    ],
)
def test_scalars(spark, function, value, want):
    assert one(spark, value, function) == want


def test_terms_and_variants(spark):
    terms = spark.createDataFrame([(["A b", " a  B ", "", "c"],)], "v array<string>")
    assert terms.select(N.unique_terms(col("v")).alias("r")).first()["r"] == ["A b", "c"]
    assert one(spark, "Acme Payments India", lambda c: F.array_join(N.company_variants(c), ";")) == "acme;acme payments india;acmepaymentsindia"
    assert one(spark, "x, Y\nx", lambda c: F.array_join(N.split_terms(c, fold=True), ";")) == "x;Y"


def test_similarity(spark):
    ratio = lambda a, b, f: spark.createDataFrame([(a, b)], "a string, b string").select(f(col("a"), col("b")).alias("r")).first()["r"]
    assert ratio("jonathon", "jonathan", N.lcs_length) == 7
    assert ratio("ring small", "small ring", N.token_sort_ratio) == 100.0


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("Ann Lee", "ann lee", 0.6), ("A Lee", "Ann Lee", 0.5), ("Ann Lee", "Bob Ray", 0.0), ("Dr. Ann Lee", "Ann Lee", 0.6), ("", "x", 0.0)],
)
def test_name_score(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(P.name_score(col("a"), col("b")).alias("r")).first()["r"] == want


def test_term_rules(spark):
    has = lambda t, w: one(spark, t, lambda c: P.term_in_text(c, w))
    assert has("Head of Data-Science", "data science") and has("datascience lead", "data science")
    assert not has("authority", "author") and not has("x", "")


def test_roles_expand_alike_in_columns_and_lists(spark):
    rows = [["CMO", "VP Sales"], ["Chief Marketing Officer", "svp vp x"], ["Painter", "Painter"], [], ["CEO & MD"]]
    got = spark.createDataFrame([(r,) for r in rows], "r array<string>").select(X.expanded_roles(F.col("r")).alias("x")).collect()
    assert [r["x"] for r in got] == [X.expand_role_terms(r) for r in rows]
