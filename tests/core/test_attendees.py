"""Attendees and what they take in turn, against plain loops; the live funnel after batches in any order."""

import itertools
import random

import pytest

from reachloom import storage
from reachloom.functions import taxonomy
from reachloom.operators import attendees as A
from reachloom.streaming.events import LiveFunnel


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_taking_in_turn_is_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    bad = {f"t{k}" for k in range(0, 12, 5)}
    rows = [(w, p, f"t{rng.randrange(12)}") for w in range(20) for p in range(rng.randint(0, 5))]
    rows = [(w, p, t, t not in bad) for w, p, t in rows]
    taken, want = set(), {}
    for w in range(20):
        free = [(p, t) for x, p, t, _ in rows if x == w and t not in taken]
        if free and (t := min(free)[1]) not in bad:
            want[w] = t
            taken.add(t)
    got = A.take_in_turn(spark.createDataFrame(rows, "who int, pick int, what string, good boolean"))
    assert {r["who"]: r["what"] for r in got.collect()} == want


def test_event_attendees(spark):
    posts = [
        (1, 1, "acme", "Speakers include Ann Lee, Bob Ray at the annual summit."), (2, 1, "acme", "Panelists include ann lee and Bob Ray at the forum panel. "),
        (3, 2, "beta", "Speakers include Ann Lee and Cyd Fox at the summit keynote speaker."),
    ]
    profiles = [
        (1, "Bob Ray - Intern at Zed | LinkedIn", "linkedin.com/in/bob0", "x"),  # neither role nor place: Bob Ray ends there
        (2, "Ann Lee - Head of Data at Acme | LinkedIn", "linkedin.com/in/ann1", "x"), (3, "Ann Lee - Painter | LinkedIn", "linkedin.com/in/ann2", "Location: Oslo · y"),
        (4, "Bob Ray - Head of Data at Acme", "linkedin.com/in/bob1", "x"), (5, "Cyd Fox - Head of Data", "https://example.org", "x"),
    ]
    direct = [
        ("acme", 1, 1, "Dee Orr - Head of Data at Acme", "linkedin.com/in/dee", "Location: Oslo · keynote speaker at the summit"),
        ("beta", 2, 2, "Ann Lee - Head of Data at Acme", "linkedin.com/in/ann1", "Location: Oslo · keynote speaker at the summit"),  # taken
        ("beta", 2, 3, "Eve Moe - Head of Data", "linkedin.com/in/eve", "Location: Oslo · nothing more"),  # no signal
    ]
    frames = (
        spark.createDataFrame(posts, "post bigint, source_no bigint, source string, text string"), spark.createDataFrame(profiles, "profile bigint, title string, href string, body string"),
        spark.createDataFrame(direct, "source string, source_no bigint, row bigint, title string, href string, body string"),
    )
    run = lambda **more: [(r["url"].split("/")[-2], r["source"], r["bucket"], r["place"]) for r in A.event_attendees(*frames, ["head of data"], ["Oslo"], **more).collect()]
    assert sorted(run()) == [("ann1", "acme", "named", "Check"), ("ann2", "beta", "named", "Yes"), ("dee", "acme", "direct", "Yes")]
    known = spark.createDataFrame([("https://www.linkedin.com/in/ann1/",), ("https://www.linkedin.com/in/bob0/",)], "url string")
    assert run(known=known, most=2) == [("ann2", "acme", "named", "Yes"), ("bob1", "acme", "named", "Check")]


def test_nothing_that_grows_with_the_input_is_sent_whole(spark, monkeypatch):
    plans = {}

    def spied(df, name, *more, real=taxonomy.saved):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, *more)

    for module in (taxonomy, A):
        monkeypatch.setattr(module, "saved", spied)
    monkeypatch.setattr(storage, "FEW_ROWS", -1, raising=False)  # no table has few
    posts = spark.createDataFrame([(1, 1, "acme", "Speakers include Ann Lee, Bob Ray at the annual summit.")], "post bigint, source_no bigint, source string, text string")
    profiles = spark.createDataFrame([(2, "Ann Lee - Head of Data at Acme | LinkedIn", "linkedin.com/in/ann1", "x")], "profile bigint, title string, href string, body string")
    direct = spark.createDataFrame([], "source string, source_no bigint, row bigint, title string, href string, body string")
    out = A.event_attendees(posts, profiles, direct, ["head of data"], [])
    plans["out"] = out._jdf.queryExecution().executedPlan().toString()
    assert [r["name"] for r in out.collect()] == ["Ann Lee"]
    assert [n for n, p in plans.items() if "BroadcastHashJoin" in p] == []


def test_the_funnel_after_batches_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["SENT", "OPENED", "CLICKED", "REPLIED", "BOUNCED", "UNSUBSCRIBED"]
    rows = [(k, k % 2, rng.randrange(15), rng.choice(kinds), rng.randrange(50)) for k in range(120)]
    state = {}
    for k, c, r, kind, _ in sorted(rows, key=lambda x: (x[4], x[0])):
        now = state.get((c, r), "SENT")
        if kind in ("REPLIED", "BOUNCED", "UNSUBSCRIBED") or (kind == "OPENED" and now == "SENT") or (kind == "CLICKED" and now in ("SENT", "OPENED")):
            now = kind
        state[c, r] = now
    want = {c: (len(s := [v for (x, _), v in state.items() if x == c]), sum(v not in ("BOUNCED", "UNSUBSCRIBED") for v in s), s.count("CLICKED"), s.count("BOUNCED")) for c in (0, 1)}
    schema = "id bigint, campaign_id int, recipient_id int, event_type string, occurred_at int"
    for order in list(itertools.permutations(range(3)))[::3]:
        live = LiveFunnel(spark, str(tmp_path / "".join(map(str, order))), 4)
        for number, part in enumerate(order):
            for _ in range(1 + (number == 1)):  # the second batch comes twice
                live.apply(spark.createDataFrame([r for r in rows if r[0] % 3 == part], schema), number)
        assert {r["campaign_id"]: (r["total"], r["sent"], r["clicked"], r["bounced"]) for r in live.read().collect()} == want
