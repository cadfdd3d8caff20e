"""Search results, result pages and people on pages: rules on literal rows, intervals against a walk over parents."""

import random

import pytest
from pyspark.sql import functions as F

from reachloom.operators import candidates as C
from reachloom.operators import intervals as I
from reachloom.operators import pages as X
from reachloom.operators import people as P
from reachloom.operators import results as R

HEADLINES = [
    ("Ira Voss - Chief Data Officer @Northwind, Ex ...", "Location: Oslo · 500+ connections", ("Ira Voss", "Chief Data Officer", "Northwind")),
    ("Ira Voss | LinkedIn", "Current: Chief Data Officer at Northwind · Location: Oslo", ("Ira Voss", "Chief Data Officer", "Northwind")),
    ("Ira Voss - Head of Sales - Acme | LinkedIn", "", ("Ira Voss", "Head of Sales", "Acme")),
    ("Ira Voss — Engineer – Acme Labs - Oslo", None, ("Ira Voss", "Engineer", "Acme Labs")),
    ("Ira Voss | Engineer | Acme", "", ("Ira Voss", "Engineer", "Acme")),
    ("Ira Voss - CTO", "Experience: Beta Works · Education: none", ("Ira Voss", "CTO", "Beta Works")),
    ("Ira Voss", "Title: Data Lead · Company: Gamma, · x", ("Ira Voss", "Data Lead", "Gamma")),
    ("Ira Voss - VP", "Currently working as Vice President of Platform at Delta | more", ("Ira Voss", "Vice President of Platform", "Delta")),
    ("Ira Voss - Vice President of Platform", "Current: VP at Delta", ("Ira Voss", "Vice President of Platform", "Delta")),
    ("Ira Voss - Oslo - Director of Ops at Epsilon Location: Oslo", "", ("Ira Voss", "Director of Ops", "Epsilon")),
    ("Ira Voss Profile page - as Director", "", ("Ira Voss", "Director", "Unknown")),
    ("ÉCurrent: Boss at Zeta", "xCurrent: Boss at Zeta", ("ÉCurrent: Boss at Zeta", "", "Unknown")),
    (None, None, ("Unknown", "", "Unknown")),
    (" - ", "Current Company: Eta", ("Unknown", "", "Eta")),
]


def test_headline_fields(spark):
    rows = [(k, t, b) for k, (t, b, _) in enumerate(HEADLINES)]
    df = spark.createDataFrame(rows, "k int, title string, body string")
    got = {r["k"]: tuple(r["f"]) for r in df.select("k", R.parse_profile_fields(F.col("title"), F.col("body")).alias("f")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(HEADLINES)}


RECORDS = '''
  "https://www.linkedin.com/in/nia-kohl/": {
    "body": "Location: Oslo. Leads \\"support\\" teams.",
    "company": "Revenue & Support",
    "designation": "Head of Support",
    "name": "Nia Kohl",
    "title": "Nia Kohl - Head of Support - Acme | LinkedIn"
  },
  "https://linkedin.com/in/Pavel-Orr/?x": {
    "body": "Experience: Beta Works · Location: Oslo",
    "name": "Pavel Orr",
    "title": "Pavel Orr - SVP | Head of ..."
  },
  "https://www.linkedin.com/company/none": {
    "name": "No Person"
  },
  "https://www.linkedin.com/in/open": { "name": "Never closed" }
'''


def test_candidates_from_results(spark):
    rows = [
        (1, "", RECORDS, "", "s1", "q1"),
        (2, "Asa Lund - CTO - Acme | LinkedIn and more", "Asa Lund leads. Nia Kohl - Head of Support - Acme. Related: https://www.linkedin.com/in/other/", "https://no.linkedin.com/in/asa-lund?x", "s2", "q2"),
        (3, "No link", "text", "https://example.org", "s3", "q1"),
        (4, None, None, "https://linkedin.com/in/nia-kohl", "s4", "q2"),
        (5, "x", '"https://linkedin.com/in/a": {\n "name": "' + "long " * 20_000 + '"\n}', "", "s5", "q5"),
    ]
    df = spark.createDataFrame(rows, "seq bigint, title string, body string, href string, source string, query string")
    found = R.candidates_from_results(df)
    url = lambda x: f"https://www.linkedin.com/in/{x}/"
    got = sorted((r["seq"] >> 20, r["url"], r["name"], r["designation"], r["company"], r["title"], r["body"]) for r in found.where("length(name) < 1000").collect())
    assert got == [
        (1, url("nia-kohl"), "Nia Kohl", "Head of Support", "Revenue & Support", "Nia Kohl - Head of Support - Acme", 'Location: Oslo. Leads "support" teams.'),
        (1, url("pavel-orr"), "Pavel Orr", "SVP | Head of ...", "Beta Works", "Pavel Orr - SVP | Head of", "Experience: Beta Works · Location: Oslo"),
        (2, url("asa-lund"), "Asa Lund", "CTO", "Acme", "Asa Lund - CTO - Acme", "Asa Lund leads."),
        (4, url("nia-kohl"), "Unknown", "", "Unknown", "", ""),
    ]
    assert found.where("length(name) = 99999").count() == 1
    merged = {r["url"]: r for r in C.merge_candidates(found).collect()}
    assert merged[url("nia-kohl")]["name"] == "Nia Kohl" and merged[url("nia-kohl")]["sources"] == ["s1", "s4"]


SEARCH = {
    1: '<li class="x b_algo"><a href="https://www.linkedin.com/in/asa-lund/?t=1">Asa <b>Lund</b> - CTO</a><p>Oslo · platforms</p><script>no()</script></li>'
       '<li class="b_algo"><a href="https://example.org">other</a></li><li class="b_algo"><a href="https://no.linkedin.com/in/asa-lund">again</a><a href="https://linkedin.com/in/nia">Nia</a></li>',
    2: '<article><a href="https://search.example/l/?uddg=https%3A%2F%2Fin.linkedin.com%2Fin%2Fnia%2F">\n Nia - Head\n</a><p>Oslo</p></article>',
    3: '<p>x</p><a href="https://www.linkedin.com/in/nia/">Nia - CTO</a>', 4: '<div class="G7"><a href="/url?q=https%3A%2F%2Fwww.linkedin.com%2Fin%2Fnia%2F"><h3>Nia - CTO</h3></a><div>Oslo</div></div>',
    5: '<div data-testid="result"><div data-testid="result"><a href="https://linkedin.com/in/deep">Deep</a></div>end</div>', 6: None, 7: "<li class='b_algo2'>no</li>",
}


def nodes_of(spark, pages):
    df = spark.createDataFrame([(k, f"https://e.org/{k}", v) for k, v in pages.items()], "page_id bigint, url string, html string")
    return X.html_nodes(df).cache()


def test_results_from_html(spark):
    nodes = nodes_of(spark, SEARCH)
    rows = lambda df: sorted((r["page_id"], r["rank"], r["url"].split("/")[-2], r["title"], r["body"]) for r in df.collect())
    assert rows(R.results_from_html(nodes)) == [
        (1, 1, "asa-lund", "Asa Lund - CTO", "Asa Lund - CTO Oslo · platforms"), (1, 2, "nia", "Nia", "again Nia"),
        (2, 1, "nia", "Nia - Head", "Nia - Head Oslo"), (3, 1, "nia", "Nia - CTO", "Nia - CTO"), (5, 1, "deep", "Deep", "Deep end"),
    ]
    assert rows(R.results_from_html(nodes, (("div", "G7", ""),), 1))[-2:] == [(4, 1, "nia", "Nia - CTO", "Nia - CTO Oslo"), (5, 1, "deep", "Deep", "Deep")]
    assert [r[:3] for r in rows(R.results_from_html(nodes, most=1)) if r[0] == 1] == [(1, 1, "asa-lund")]


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_hold_what_parents_say(spark, seed):
    rng = random.Random(seed)
    body = "".join(rng.choice(["<div class='a'>", "<p>", "</p>", "</div>", "<br>", "text ", "<a href='x'>", "</a>", "<ul><li>", "</ul>"]) for _ in range(400))
    rows = X.Elements(body).rows
    nodes = nodes_of(spark, {1: body, 2: "<p>" * 300, 3: "<div class='a'>x</div>"})
    cards = nodes.where("tag IN ('div', 'p', '#root')").select("page_id", "node", "last", "levels")
    got = {(r["outer"], r["node"]) for r in I.within(cards, nodes.select("page_id", "node")).where("page_id = 1").collect()}
    want = set()
    for r in rows:
        up = r["parent"]
        while up >= 0:
            if rows[up]["tag"] in ("div", "p", "#root"):
                want.add((up, r["node"]))
            up = rows[up]["parent"]
    assert got == want and I.within(cards, nodes.select("page_id", "node")).count() == len(want) + sum(range(301)) + 3
    texts = {r["node"]: r["text"] for r in I.text_within(nodes, nodes.where("tag = 'div'").select("page_id", "node")).where("page_id = 1").collect()}
    pieces = {n: " ".join(r["text"] for r in rows if r["tag"] == "#text" and (n, r["node"]) in want) for n, _ in want if rows[n]["tag"] == "div"}
    assert texts == {n: t for n, t in pieces.items() if t}


LINKS = {
    1: '<a href="https://linkedin.com/in/a">Ann Marie Lee VP at Beta</a>', 2: '<a href="https://linkedin.com/in/a">Ann Lee CX Director, Ops at Gama Co</a>',
    3: '<a href="https://linkedin.com/in/a">Ann Lee · CTO at Beta</a><a href="https://linkedin.com/in/A/">Other Name</a>',
    4: '<div><h3>Old Name</h3><h3>Ann Lee</h3><p>Current: CTO at Beta</p><a href="https://linkedin.com/in/a">LinkedIn</a><h3>Next One</h3><p>x</p><a href="https://linkedin.com/in/b">LinkedIn</a></div>',
    5: '<section class="box"><h3>Ann Lee - VP Sales - Beta</h3><p>Oslo</p><p><a href="https://linkedin.com/in/a">LinkedIn</a></p></section>',
    6: '<div class="teamlist"><span class="the-name">Ann Lee</span><i><a href="https://linkedin.com/in/a"><img src="x"></a></i></div>',
    7: '<a href="https://linkedin.com/company/a">Acme</a><a href="/in/a">x</a>', 8: 'Ann <a href="https://linkedin.com/in/a">Profile · CTO</a>',
    9: '<a href="https://linkedin.com/in/a">Ann Lee Longs of sales at Beta</a>',
}


def test_profile_links(spark):
    got = sorted((r["page_id"], r["link"].split("/")[-2], r["name"], r["designation"], r["company"]) for r in P.profile_links(nodes_of(spark, LINKS)).collect())
    assert got == [
        (1, "a", "Ann Marie", "Lee VP", "Beta"), (2, "a", "Ann Lee", "CX Director, Ops", "Gama Co"), (3, "a", "Ann Lee", "CTO", "Beta"),
        (4, "a", "Ann Lee", "CTO", "Beta"), (4, "b", "Next One", "", "Unknown"), (5, "a", "Ann Lee", "VP Sales", "Beta"),
        (6, "a", "Ann Lee", "", "Unknown"), (8, "a", "Profile · CTO", "", "Unknown"), (9, "a", "Ann Lee Longs", "of sales", "Beta"),
    ]


CARDS = {
    1: '<div class="speaker-card"><h3>Max Dow</h3><h4>Head of Data at Gamma</h4><a href="https://linkedin.com/in/max">in</a></div>'
       '<div class="my-speaker-box"><h3>Eve Moe</h3><h4>CTO</h4><strong>Beta</strong></div><div class="speaker-item"><h3>Room 101</h3></div>',
    2: '<li class="member"><h4>Max Dow</h4><p>Current: CTO at Acme</p></li><li class="member"><h4>Max Dow</h4></li><li class="member"><h4>Room 101</h4></li>'
       '<div class="lineup"><h2>Kim Poe</h2><h3>Title: Data Lead</h3></div><section class="person"><h3>Not Here</h3></section>',
    3: f'<div class="people-members">{"<p>word</p>" * 400}<h3>Big Box</h3></div>',
}


def test_cards(spark):
    nodes = nodes_of(spark, CARDS)
    rows = lambda df: sorted((r["page_id"], r["name"], r["designation"], r["company"], r["link"]) for r in df.collect())
    assert rows(P.overlay_cards(nodes)) == [(1, "Eve Moe", "CTO", "Beta", ""), (1, "Max Dow", "Head of Data", "Gamma", "https://www.linkedin.com/in/max/")]
    assert [r for r in rows(P.person_cards(nodes)) if r[0] > 1] == [(2, "Kim Poe", "Data Lead", "Unknown", ""), (2, "Max Dow", "CTO", "Acme", "")]
    raw = P.raw_people(nodes.where("node = 0").select("page_id", "url").join(spark.createDataFrame(list(CARDS.items()), "page_id bigint, html string"), "page_id"))
    assert sorted((r["page_id"], r["dataset"]) for r in raw.collect()) == [(1, "overlay_cards")] * 2 + [(1, "visible_profile_links")] + [(2, "person_cards")] * 2


def test_first_record_stays_and_only_its_profile_replaces_it(spark):
    given = [
        {"id": 7, "name": "Ann Lee"}, {"id": 7, "name": "Anna Leigh", "jobTitle": "CTO", "company": "Beta"},  # same id, no profile: the first stays
        {"id": 8, "name": "Bo Ray", "linkedin": "https://linkedin.com/in/bo"}, {"id": 9, "name": "Bo Rayner", "jobTitle": "CTO", "linkedin": "https://linkedin.com/in/bo"},
        {"id": 9, "name": "Cy Fox"}, {"id": 10, "name": "cy fox", "country": "NO"}, {"id": 11, "name": "Di Ash"},
    ]
    import json

    html = f'<script>{{"speakers": {json.dumps(given)}}}</script>'
    people, _ = P.extract_people(spark.createDataFrame([(1, "https://e.org", html)], "page_id bigint, url string, html string"))
    assert sorted((r["name"], r["designation"]) for r in people.collect()) == [("Ann Lee", ""), ("Bo Rayner", "CTO"), ("Cy Fox", ""), ("Di Ash", "")]
