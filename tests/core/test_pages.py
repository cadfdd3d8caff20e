"""Pages and send slots on literal rows."""

import datetime

from pyspark.sql import functions as F

from reachloom.operators import pages as X
from reachloom.operators import people as P
from reachloom.operators import scheduling as S

HTML = (
    '<html><body class="b"><h2>Ann Lee</h2><p>Call our office: +44 20 7946 0018 today</p><p>invoice 20240131</p>'
    '<a href="/about/team?x=1#y">Team</a><a href="mailto:a@example.com">m</a><a href="/login/contact">no</a>'
    '<a href="https://other.example.org/contact">o</a><script>var a = "<p>no</p>";</script></body></html>'
)


def test_pages(spark):
    rows = [(1, "https://www.example.com/en/index.html", HTML), (2, "https://example.com", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    nodes = {(r["tag"], r["text"]) for r in X.html_nodes(pages).collect()}
    assert ("h2", "Ann Lee") in nodes and ("a", "Team") in nodes
    assert [r["link"] for r in X.relevant_links(pages).collect()] == ["https://www.example.com/about/team"]
    text = pages.select("page_id", X.plain_text(F.col("html")).alias("t"))
    assert "var a" not in text.first()["t"]
    assert [(r["phone"], r["kind"]) for r in X.phones_from_pages(pages).collect()] == [("+442079460018", "business_phone")]


def test_phones_on_both_sides_of_a_cue(spark):
    rows = [
        (1, "<p>Phone: 080 1234 5678, 080 8765 4321</p>"), (2, "<p>080 1234 5678 (office)</p>"), (3, "<p>080 1234 5678</p>"),
        (4, '<ul><li>Ann Lee <b>desk</b> <a href="tel:+44 20 7946 0018?x">x</a></li><li>other</li></ul><p>call +44 20 7946 0018</p>'), (5, None),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, html string")
    got = {(r["page_id"], r["phone"], r["attribution"], r["confidence"]) for r in X.phones_from_pages(pages, "Ann Lee").collect()}
    assert got == {
        (1, "08012345678", "company_general", "low"), (1, "08087654321", "company_general", "low"), (2, "08012345678", "company_general", "low"),
        (4, "+442079460018", "leader_context", "high"),
    }


def test_windows(spark):
    cases = {
        datetime.datetime(2024, 3, 1, 10): datetime.datetime(2024, 3, 1, 10),  # Friday inside
        datetime.datetime(2024, 3, 1, 5): datetime.datetime(2024, 3, 1, 9),
        datetime.datetime(2024, 3, 1, 18): datetime.datetime(2024, 3, 4, 9),
        datetime.datetime(2024, 3, 2, 12): datetime.datetime(2024, 3, 4, 9),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t timestamp")
    got = df.select("t", S.align_to_window(F.col("t"), "UTC", (0, 1, 2, 3, 4), 9, 18).alias("at")).collect()
    assert {r["t"]: r["at"] for r in got} == cases


def test_slots_keep_the_daily_cap(spark):
    rows = spark.range(650).select("id", F.lit(1).alias("campaign_id"))
    got = S.daily_slots(rows, "2024-03-01", 9, 4, 5, 100)
    per = got.groupBy(F.to_date("send_at")).agg(F.count(F.lit(1)).alias("n"), F.max(F.hour("send_at")).alias("h")).collect()
    assert sum(r["n"] for r in per) == 650 and max(r["n"] for r in per) == 100 and max(r["h"] for r in per) < 18


PEOPLE = {
    1: '<script>var d = {"speakers": {"data": [{"fullName": "Ann Lee", "jobTitle": "CTO", "company": {"name": "Acme"}, "linkedin": "https://in.linkedin.com/in/Ann-Lee?x"},'
       '{"firstName": "Bob", "lastName": "Ray", "isActive": false}, {"person": {"name": "Kim Poe", "location": {"addressCountry": "India"}}, "id": 7}]}}</script>'
       '<a href="https://www.linkedin.com/in/ann-lee/">Ann Lee CTO at Acme</a>',
    2: '<script type="application/ld+json">{"@graph": [{"@type": "Person", "name": "Eve Moe", "worksFor": {"name": "Beta"}, "sameAs": ["https://x.org", "https://linkedin.com/in/eve"]},'
       '{"@type": "Thing", "name": "No One"}]}</script>',
    3: '<div class="speaker-card"><h3>Max Dow</h3><h4>Head of Data at Gamma</h4><a href="https://linkedin.com/in/max">in</a></div><li class="member"><h4>Room 101</h4></li>',
    4: "<p>nobody</p>", 5: None,
    6: r'<script>self.__next_f.push([1,"{\"people\": [{\"name\": \"Lia Orr\", \"status\": \"draft\"}, {\"name\": \"Tom Ash\"}]}"])</script>',
}


def test_people_on_pages(spark):
    pages = spark.createDataFrame([(k, f"https://e.org/{k}", v) for k, v in PEOPLE.items()], "page_id bigint, url string, html string")
    people, none = P.extract_people(pages)
    got = sorted((r["page_id"], r["name"], r["designation"], r["company"], r["country"], r["profile_url"], r["match_status"]) for r in people.collect())
    url = lambda x: f"https://www.linkedin.com/in/{x}/"
    assert got == [
        (1, "Ann Lee", "CTO", "Acme", "", url("ann-lee"), "provided"), (1, "Kim Poe", "", "Unknown", "India", "", "not_found"),
        (2, "Eve Moe", "", "Beta", "", url("eve"), "provided"), (3, "Max Dow", "Head of Data", "Gamma", "", url("max"), "provided"),
        (6, "Tom Ash", "", "Unknown", "", "", "not_found"),
    ]
    assert sorted(r["page_id"] for r in none.collect()) == [4, 5]
