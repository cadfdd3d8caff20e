"""The strict profile parser and places, on cases with invented names."""

from pyspark.sql import functions as F

from reachloom.operators import profiles as P

URL = "https://www.linkedin.com/in/ira-voss/"
CASES = [
    ("Ira Voss - Chief Data Officer at Acme Corp | LinkedIn", "", ("Ira Voss", "Chief Data Officer", "Acme Corp")),
    ("Ira Voss - VP Data - Acme Corp | LinkedIn", "", ("Ira Voss", "VP Data", "Acme Corp")),
    ("Ira Voss - Acme Corp - VP Data | LinkedIn", "", ("Ira Voss", "VP Data", "Acme Corp")),
    ("Ira Voss - Data Leader - Head of Data at Acme | LinkedIn", "", ("Ira Voss", "Head of Data", "Acme")),
    ("Ira Voss - Chief Data Officer | LinkedIn", "Experience: Old Firm · Education: Some School", ("Ira Voss", "Chief Data Officer", "Unknown")),
    ("Ira Voss | LinkedIn", "Current: Chief Data Officer at Acme Corp · Location: Oslo", ("Ira Voss", "Chief Data Officer", "Acme Corp")),
    ("Ira Voss | LinkedIn", "x Current: Acme Corp | Title: Data Director", ("Ira Voss", "Data Director", "Acme Corp")),
    ("Ira Voss - New Delhi, Delhi, India | Professional Profile", "", ("Ira Voss", "", "Unknown")),
    ("Ira V. - Zenith | LinkedIn", "As the Sr Director of Data at Zenith, I lead teams. · Experience: Zenith · Location: Oslo · 500+ connections on LinkedIn.", ("Ira V.", "Sr Director of Data", "Zenith")),
    ("Ira - Head of Data - Looking for the ... | LinkedIn", "· Experience: QuickCo · Education: Some School · Location: Oslo · 500+ connections on LinkedIn.", ("Ira", "Head of Data", "QuickCo")),
    ("Ira V. - Data Leader | Head of Data at CloudCo | LinkedIn", "", ("Ira V.", "Head of Data", "CloudCo")),
    ("Ira Voss, Lund - Harbor Lane Works", "United States · Head of Data · Harbor Lane Works Experience · Director, Global Data", ("Ira Voss, Lund", "Head of Data", "Harbor Lane Works")),
    ("Ira V - Head of Data | LinkedIn", "Oslo, Viken, Norway · Head of Data · Railco Recruiting the Future, Today", ("Ira V", "Head of Data", "Railco")),
    ("Ira Voss | Director of Data | Scaling AI & ...", "Bay Area · AI / ML Staffing · Gemco Ira Voss | Director of Data | Scaling AI & Teams", ("Ira Voss", "Director of Data", "Gemco")),
    ("Ira Voss | LinkedIn", "Hiring a Director of Data at Acme", ("Ira Voss", "", "Unknown")),
    ("Ira Voss | LinkedIn", "I am currently the Director of Data at Acme. More", ("Ira Voss", "Director of Data", "Unknown")),
    ("Ira Voss - CTO | LinkedIn", "View Bo Ray's profile on LinkedIn. Experience: Other Firm · Location: Oslo", ("Ira Voss", "CTO", "Unknown")),
    ("Ira Voss - CTO | LinkedIn", "View Ira Voss' s profile. Experience: Own Firm · Location: Oslo", ("Ira Voss", "CTO", "Own Firm")),
    ("Ira Voss | LinkedIn", "Head of Data - 12 years of work. Company: Acme", ("Ira Voss", "Head of Data", "Acme")),
    ("Ira Voss - CTO at Acme | LinkedIn", "x | Ción osta. Edor estior at itertion", ("Ira Voss", "CTO", "Acme")),  # no CIO
    ("Ira Voss - CTO at Acme | LinkedIn", "The_Head_of Data, estratégica at Beta", ("Ira Voss", "The_Head_of Data, estratégica", "Beta")),
    (None, None, ("Unknown", "", "Unknown")),
]


def test_strict_profiles(spark):
    rows = [(k, t, URL, b, "old") for k, (t, b, _) in enumerate(CASES)] + [(99, "Ira Voss - CTO", "https://example.org", "", "old")]
    df = spark.createDataFrame(rows, "k int, title string, href string, body string, company string")
    got = {r["k"]: (r["name"], r["designation"], r["company"]) for r in P.parse_profiles(df).collect()}
    want = {k: w for k, (_, _, w) in enumerate(CASES)} | {99: (None, None, None)}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


PLACES = [
    ("x Location: Oslo, Norway · y", "", "Oslo, Norway", "Oslo, Norway"), ("Oslo, Viken · Head of Data · Acme", "", "Oslo, Viken", "Oslo, Viken"),
    ("worked in Oslo once", "", "Oslo", ""), ("x" * 430 + " Oslo", "", "", ""), ("x" * 430 + " Location: Oslo", "", "Oslo", "Oslo"), ("NCR Voy", "", "", ""),
    ("in Delhi NCR now", "", "Delhi NCR", ""), ("Location: NCR", "", "NCR", "NCR"), ("", "Ira - Oslo, Norway | LinkedIn", "Oslo, Norway", "Oslo, Norway"),
    ("", "Ira - Oslo | LinkedIn", "", ""), ("View Bo Ray's profile on LinkedIn Location: Oslo", "", "Oslo", ""), (None, None, "", ""),
]


def test_places(spark):
    rows = [(k, b, t) for k, (b, t, _, _) in enumerate(PLACES)]
    df = spark.createDataFrame(rows, "k int, body string, title string")
    for strict in (False, True):
        found = P.profile_location(F.col("body"), F.col("title"), ["Oslo", "NCR"], strict, F.lit("Ira Voss"))
        got = {r["k"]: r["p"] for r in df.select("k", found.alias("p")).collect()}
        assert got == {k: row[3 if strict else 2] for k, row in enumerate(PLACES)}
    assert df.select(P.profile_location(F.col("body"), F.col("title"), []).alias("p")).first()["p"] == "Not requested"
