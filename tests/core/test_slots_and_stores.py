"""Send slots against a plain loop, combinations against enumeration, stores against one merge of everything."""

import datetime
import itertools
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from reachloom.operators import ordering as O
from reachloom.operators import scheduling as S
from reachloom.sources import store as T

SETTINGS = [
    (datetime.datetime(2024, 3, 1, 10, 30), "Asia/Kolkata", (0, 1, 2, 3, 4), 9, 18, 10, 30, 27),
    (datetime.datetime(2024, 3, 2, 20, 5, 7), "UTC", (0, 1, 2, 3, 4), 9, 18, 1, 1, 100),  # the 650 sends of a plain schedule
    (datetime.datetime(2024, 3, 6, 3, 0), "America/New_York", (1, 5), 22, 24, 0, 90, 3),
    (datetime.datetime(2024, 3, 6, 12, 0), "UTC", (0, 1, 2, 3, 4, 5, 6), 0, 12, 0, 0, 1000),
]


def loop(campaign, count, start, zone, weekdays, first, last, least, most, daily):
    plan = S.Schedule(start, weekdays, first, last, least, most, daily)

    def next_day(t):
        t = (t + datetime.timedelta(days=1)).replace(hour=first, minute=0, second=0)
        while t.weekday() not in weekdays:
            t += datetime.timedelta(days=1)
        return t

    def aligned(t):
        while True:
            begin = t.replace(hour=first, minute=0, second=0)
            if t.weekday() in weekdays and t < begin:
                return begin
            if t.weekday() in weekdays and t < begin + datetime.timedelta(hours=last - first):
                return t
            t = next_day(t)

    out, now, day, sent = [], start, None, 0
    for n in range(count):
        now = aligned(now + datetime.timedelta(seconds=plan.gap(campaign, n) if n else 0))
        if day != now.date():
            day, sent = now.date(), 0
        if sent >= daily:
            now = next_day(now)
            day, sent = now.date(), 0
        sent += 1
        out.append(now.replace(tzinfo=ZoneInfo(zone)).astimezone(datetime.UTC).replace(tzinfo=None))
    return out


@pytest.mark.parametrize("stretch", [1 << 16, 40])
@pytest.mark.parametrize("setting", SETTINGS)
def test_slots_equal_a_loop(spark, monkeypatch, setting, stretch):
    monkeypatch.setattr(S, "STRETCH", stretch)
    rows = spark.range(650).selectExpr("id", "1 AS campaign_id").union(spark.range(1000, 1123).selectExpr("id", "2")).union(spark.range(5).selectExpr("id", "CAST(NULL AS INT)"))
    got = {}
    for r in S.send_slots(rows, *setting).orderBy("id").collect():
        got.setdefault(r["campaign_id"], []).append(r["send_at"])
    for campaign, count in ((1, 650), (2, 123), (None, 5)):
        assert got[campaign] == loop("" if campaign is None else str(campaign), count, *setting)


def test_long_gaps_are_refused():
    with pytest.raises(ValueError):
        S.Schedule(datetime.datetime(2024, 3, 1), (0,), 0, 24, 5, 9, 10)


@pytest.mark.parametrize("sizes", [(3, 2), (2, 5, 3), (2, 3, 1, 4), (4,)])
def test_combinations_by_enumeration(spark, sizes):
    dims = [spark.createDataFrame([(f"{'abcd'[k]}{i}",) for i in range(n)], f"{'abcd'[k]} string") for k, n in enumerate(sizes)]
    indexed = sorted(itertools.product(*(range(n) for n in sizes)), key=lambda x: (sum(x), max(x), x))
    cover = [tuple(t % n for n in sizes) for t in range(max(sizes))]
    want = [tuple(f"{'abcd'[k]}{i}" for k, i in enumerate(x)) for x in dict.fromkeys([*cover, *indexed])]
    got = O.combinations(dims)
    assert [tuple(r)[:-1] for r in got.orderBy("place").collect()] == want
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def leads(spark, rows):
    return spark.createDataFrame(rows, "url string, first_seen int, last_seen int, name string, designation string, company string")


def test_batches_and_replays_give_what_one_merge_gives(spark, tmp_path):
    rows = [(f"u{k % 37}", k, k, f"n{k}", f"d{k % 3}", None if k % 5 else f"c{k}") for k in range(300)]
    parts = [rows[:100], rows[100:200], rows[200:]]
    store = T.lead_store(spark, str(tmp_path / "leads"), buckets=8)
    assert store.read() is None
    for number, part in enumerate(parts):
        store.upsert(leads(spark, part), number)
        store.upsert(leads(spark, part), number)  # again
    store.upsert(leads(spark, parts[0]), 0)  # late
    one = T.lead_store(spark, str(tmp_path / "one"), buckets=8)
    one.upsert(leads(spark, rows), 0)
    key = lambda df: sorted(tuple(r[c] for c in ("url", "first_seen", "last_seen", "name", "designation", "company")) for r in df.collect())
    assert key(store.read()) == key(one.read()) and store.read().count() == 37


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = T.metric_store(spark, str(tmp_path / "m"), buckets=16)
    schema = "job string, name string, added bigint, value bigint, at int"
    store.upsert(spark.createDataFrame([(f"j{k}", "n", 1, k, 1) for k in range(100)], schema), 1)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "m").rglob("*.parquet")}
    store.upsert(spark.createDataFrame([("j5", "n", 2, 50, 2), ("j5", "n", 3, 40, 1)], schema), 2)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "m").rglob("*.parquet")}
    assert len(set(before) & set(after)) == len(before) - 1
    row = store.read().where("job = 'j5'").first()
    assert (row["added"], row["value"], row["at"]) == (6, 50, 2) and store.read().count() == 100


def test_evidence_expires(spark, tmp_path):
    store = T.evidence_store(spark, str(tmp_path / "e"), buckets=4)
    schema = "job string, kind string, key string, evidence string, expires int, created int"
    store.upsert(spark.createDataFrame([("j", "k", "a", "old", 5, 1), ("j", "k", "b", "stays", None, 1)], schema), 1)
    store.upsert(spark.createDataFrame([("j", "k", "a", "new", 9, 2)], schema), 2)
    assert sorted(r["evidence"] for r in T.valid_evidence(store, F.lit(6)).collect()) == ["new", "stays"]
    assert [r["evidence"] for r in T.valid_evidence(store, F.lit(9)).collect()] == ["stays"]
