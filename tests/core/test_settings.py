"""Operators with settings, on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from reachloom.functions import taxonomy as X
from reachloom.operators import campaigns as M
from reachloom.operators import candidates as C
from reachloom.operators import graph, ordering, schemas, signals

col = F.col


def test_term_hits(spark):
    rows = spark.createDataFrame([(1, "Head of Data-Science at Acme"), (2, "datascience"), (3, None), (4, "")], "id int, t string")
    terms = spark.createDataFrame([("data science",), ("acme",), ("data",), ("",), (None,), ("head",)], "term string")
    for most in (10_000, 1):
        got = {(r["id"], r["term"]) for r in X.term_hits(rows, "id", "t", terms, most).collect()}
        assert got == {(1, "data science"), (2, "data science"), (1, "acme"), (1, "data"), (1, "head")}


def test_roles(spark):
    names = X.Taxonomy((X.Entry("CTO", ("Chief Technology Officer",), "technology", "executive"), X.Entry("Chief Architect", (), "technology", "executive")))
    got = spark.createDataFrame([("Chief Technology Officer",), ("Chief Architect",), ("CTO Office",), ("XYZ",), ("xyz lead",), ("xyz guy",), (None,)], "d string").select(
        X.role_match_strength(col("d"), "CTO", names), X.role_match_strength(col("d"), "XYZ", names)).collect()
    assert [tuple(r) for r in got] == [(3, 0), (2, 0), (3, 0), (0, 3), (0, 3), (0, 0), (0, 0)]
    assert X.expand_role_terms(["CEO", "VP Sales", "x"]) == ["ceo", "chief executive officer", "VP Sales", "vp sales", "vice president sales", "x"]


def test_states_follow_the_events_in_order(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [
        (1, "a", "OPENED", at(1)), (2, "a", "CLICKED", at(2)), (3, "a", "OPENED", at(3)), (4, "b", "BOUNCED", at(1)), (5, "b", "UNSUBSCRIBED", at(2)),
        (6, "b", "OPENED", at(3)), (7, "c", "SENT", at(1)), (8, "d", "UNSUBSCRIBED", at(1)), (9, "d", "REPLIED", at(1)),
    ]
    got = M.recipient_state(spark.createDataFrame(rows, "id int, recipient_id string, event_type string, occurred_at timestamp")).collect()
    assert {r["recipient_id"]: (r["status"], r["open_count"], r["suppressed"]) for r in got} == {
        "a": ("CLICKED", 2, False), "b": ("UNSUBSCRIBED", 1, True), "c": ("SENT", 0, False), "d": ("REPLIED", 0, True)}


def test_templates(spark):
    assert M.template_tokens("{{a}} {{ b }}", "{{a}}") == ["a", "b"]
    for bad in ("{% if x %}", "{{ a.b }}", "{# x #}"):
        with pytest.raises(ValueError):
            M.template_tokens(bad)
    row = spark.createDataFrame([({"x": "<1>"},)], "c map<string,string>")
    assert row.select(M.render("a{{x}}b", col("c"), html=True)).first()[0] == "a&lt;1&gt;b"
    with pytest.raises(Exception, match="undefined"):
        row.select(M.render("{{y}}", col("c"))).collect()


def test_intake_without_a_decision_column(spark):
    rows = spark.createDataFrame([(1, "A@x.org", "", "Ann", "Lee"), (2, "a@x.org", "B", "", ""), (3, "no", "C", "", "")], "seq int, mail string, name string, f string, l string")
    mapping = {"email": "mail", "full_name": "name", "first_name": "f", "last_name": "l"}
    got = [tuple(r) for r in M.intake(rows, mapping, confirmed_safe=True).orderBy("seq").select("reason", "email", "full_name", "first_name").collect()]
    assert got == [("", "a@x.org", "Ann Lee", "Ann"), ("duplicate_email_in_source", "a@x.org", "B", ""), ("invalid_or_blank_email", "no", "C", "")]
    assert {r["reason"] for r in M.intake(rows, mapping).collect()} == {"safe_status_not_confirmed", "invalid_or_blank_email"}
    with pytest.raises(ValueError):
        M.intake(rows, {"email": "none"})


def test_validate_takes_the_first_good_row_of_a_url(spark):
    made = [(k, u, n, "VP Sales", "Acme", "t", "b", "q", "e", ["google web", "Google"], "") for k, u, n in (
        (1, "u1", "x"), (2, "u1", "Ann Lee"), (3, "u1", "Ann Lee"), (4, "", "Ann Lee"), (5, "u2", "Ann Lee"))]
    rows = spark.createDataFrame(made, "seq int, url string, name string, designation string, company string, title string, body string, query string, evidence string, sources array<string>, company_evidence string")
    known = spark.createDataFrame([("u2",)], "url string")
    got = {r["seq"]: r["reason"] for r in C.validate(rows, C.Request(), known).collect()}
    assert got == {1: "incomplete", 2: "", 3: "duplicate", 4: "invalid_linkedin_url", 5: "duplicate"}
    got = {r["seq"]: r["reason"] for r in C.validate(rows, C.Request(least_sources=2)).collect()}
    assert got[2] == "source_count"


def test_numbered(spark):
    rows = spark.range(1000).select("id", (col("id") * 7919 % 1000).alias("k"))
    got = ordering.numbered(rows.repartition(7), [F.desc("k")]).collect()
    assert all(r["rank"] == 1000 - r["k"] for r in got)
    assert ordering.numbered(rows.limit(0), [F.desc("k")]).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (7, 7), *[(100, k) for k in range(101, 160)]], "a int, b int")
    got = {r["id"]: r["component"] for r in graph.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {k: 100 for k in range(100, 160)}
    more = spark.createDataFrame([(5, 159)], "a int, b int").unionByName(graph.components(links).selectExpr("id AS a", "component AS b"))
    assert {r["id"]: r["component"] for r in graph.components(more).collect()}[120] == 4


def test_signals(spark):
    rows = [(1, "", "Bluetooth speaker", "x"), (2, "Ann, keynote speaker", "", "Ann"), (3, "", "y " * 300 + "award winner", "Ann"),
            (4, "", "y " * 100 + "ann is an award winner", "Ann"), (5, None, None, None), (6, "", "the speaker of the summit", "")]
    got = {r["id"]: (r["name"], r["score"], r["confidence"], r["attribution"]) for r in
           signals.assess_signal(spark.createDataFrame(rows, "id int, title string, body string, person string"), "id").collect()}
    none = ("No Verified Signal", 35, "None", "none")
    assert got == {1: none, 2: ("Past Speaker", 95, "High", "title"), 3: none, 4: ("Award Recipient", 88, "High", "named snippet"), 5: none,
                   6: ("Past Speaker", 90, "Medium", "profile snippet")}


def test_participants(spark):
    rows = [(1, "The panelists include Ann Lee at the summit. Others left."), (2, "Ann Lee bought bread."), (3, "Bob Ray was a speaker at the forum, a keynote speaker.")]
    got = {(r["id"], r["name"]) for r in signals.event_participants(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert got == {(1, "Ann Lee"), (3, "Bob Ray")}


def test_stored_tables(spark):
    for name in schemas.TABLES:
        assert schemas.empty_table(spark, name).count() == 0
    got = schemas.conformed(spark.createDataFrame([(1, "x", "r")], "id int, extra string, status string"), "recipients")
    assert got.first()["id"] == "1" and got.columns == schemas.empty_table(spark, "recipients").columns
