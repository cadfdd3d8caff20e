"""Send windows and slots, campaign by campaign."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .ordering import numbered


def align_to_window(ts: Column, zone: str, weekdays: tuple[int, ...], start_hour: int, end_hour: int) -> Column:
    """Ts moved into [start, end) hours of an allowed weekday (Monday is 0) of a zone. Before the start: that day's
    start; after the end or on another day: the next allowed day's start."""
    local = F.from_utc_timestamp(ts, zone)
    day, hour = F.to_date(local), F.hour(local)
    ahead = [min(d for d in range(1, 8) if (w + d) % 7 in weekdays) for w in range(7)]
    next_day = F.date_add(day, F.get(F.array(*map(F.lit, ahead)), F.weekday(day)))
    allowed = F.weekday(day).isin(*weekdays)
    at_start = lambda d: F.timestamp_seconds(F.unix_timestamp(d.cast("timestamp")) + start_hour * 3600)
    moved = (
        F.when(allowed & (hour >= start_hour) & (hour < end_hour), local)
        .when(allowed & (hour < start_hour), at_start(day))
        .otherwise(at_start(next_day))
    )
    return F.to_utc_timestamp(moved, zone)


def gap_minutes(seed: Column, number: Column, least: int, most: int) -> Column:
    """A repeatable gap between two sends, from a hash of the campaign and the recipient's number."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), number.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.lit(least) + F.pmod(digits, F.lit(most - least + 1))


def daily_slots(recipients: DataFrame, first_day: str, start_hour: int, least: int, most: int, daily: int) -> DataFrame:
    """D21 for windows that hold a day's sends: id, campaign_id, send_at.

    Recipients of a campaign are numbered in order, `daily` a day; a day's gaps add up from its start. `daily * most`
    minutes have to fit into the window, so no slot leaves it.
    """
    order = Window.partitionBy("campaign_id").orderBy("id")
    rows = recipients.select("id", "campaign_id", (F.row_number().over(order) - 1).alias("n"))
    rows = rows.withColumn("day", F.floor(F.col("n") / daily).cast("int")).withColumn(
        "gap", F.when(F.col("n") % daily == 0, 0).otherwise(gap_minutes(F.col("campaign_id"), F.col("n"), least, most)))
    minutes = F.sum("gap").over(Window.partitionBy("campaign_id", "day").orderBy("n"))
    start = F.unix_timestamp(F.date_add(F.lit(first_day).cast("date"), F.col("day")).cast("timestamp")) + start_hour * 3600
    return rows.select("id", "campaign_id", F.timestamp_seconds(start + minutes * 60).alias("send_at"))


#: Sends of a campaign that one task places.
STRETCH = 1 << 16


class Schedule:
    """A campaign's sends as days: a day begins at the window's start (the first one at the aligned start), and lasts until
    its sends reach the target or the next one would leave the window. Since no gap is longer than a night, the day after
    begins at its window's start whatever the gap was: where a day begins says all that follows.

    A stretch of sends is therefore a function from the beginning of the day that is open before it to that of the day that
    is open at its end, and the days between; functions of neighbouring stretches are applied one after the other.
    """

    def __init__(self, start: datetime.datetime, weekdays: tuple[int, ...], start_hour: int, end_hour: int, least: int, most: int, daily: int):
        if most * 60 > (24 - (end_hour - start_hour)) * 3600:
            raise ValueError("a gap must not be longer than the time between two windows")
        if not weekdays or least < 0 or most < least or daily < 1 or not 0 <= start_hour < end_hour <= 24:
            raise ValueError("a schedule needs days, a window, gaps and a daily target")
        self.window, self.least, self.most, self.daily = (end_hour - start_hour) * 3600, least, most, daily
        self.start_hour, self.mask = start_hour, [d in weekdays for d in range(7)]
        day, at = start.date(), start.hour * 3600 + start.minute * 60 + start.second - start_hour * 3600
        if at >= self.window or not self.mask[day.weekday()]:
            day, at = day + datetime.timedelta(days=1), 0
            while not self.mask[day.weekday()]:
                day += datetime.timedelta(days=1)
        self.first_day, self.lead = np.datetime64(day), max(at, 0)
        #: Sends of a day at most.
        self.longest = daily if least == 0 else min(daily, self.window // (least * 60) + 1)
        self.stretch = max(STRETCH, 4 * self.longest)

    def gap(self, campaign: str, number: int) -> int:
        """gap_minutes() in seconds: the time before a send."""
        return 60 * (self.least + int(hashlib.md5(f"{campaign}|{number}".encode()).hexdigest()[:8], 16) % (self.most - self.least + 1))

    def days(self, campaign: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """For the sends from low to high: seconds since low's, and for each the first send of the next day if it begins one
        (high + 1 where that lies beyond)."""
        passed = np.cumsum([0, *(self.gap(campaign, k) for k in range(low + 1, high + 1))])
        n = len(passed)
        room = np.full(n, self.window)
        if low == 0:
            room[0] -= self.lead
        after = np.minimum(np.arange(n) + self.daily, np.searchsorted(passed, passed + room, "left"))
        return passed, low + np.minimum(after, n)


def send_slots(
    recipients: DataFrame, start: datetime.datetime, zone: str, weekdays: tuple[int, ...], start_hour: int, end_hour: int, least: int, most: int, daily: int
) -> DataFrame:
    """Id, campaign_id, send_at (UTC) for campaigns of any size: sends in order of id, the first at `start` (local time,
    moved into the window), each a gap after the one before (gap_minutes), moved to the next allowed day's start where it
    leaves the window or the day has its target. Recipients of a null campaign are one campaign.

    Sends are numbered by ranges of the order; stretches of each campaign become functions side by side, whose results are
    chained (a few numbers for each stretch, streamed by campaign), and stretches are then filled side by side.
    """
    plan = Schedule(start, weekdays, start_hour, end_hour, least, most, daily)
    own = [c for c in recipients.columns if c in ("id", "campaign_id")]
    rows = saved(numbered(recipients.select(*own), [F.col("campaign_id"), F.col("id")], "__place"), "sends")
    firsts = rows.groupBy("campaign_id").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__count"))
    key = F.coalesce(F.col("campaign_id").cast("string"), F.lit(""))
    size = plan.stretch
    stretches = firsts.select(key.alias("key"), F.explode(F.sequence(F.lit(0), F.floor((F.col("__count") - 1) / size))).alias("stretch"))

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for campaign, stretch in zip(batch["key"], batch["stretch"], strict=True):
                base = stretch * size
                low, end = max(0, base - plan.longest + 1), base + size
                after = plan.days(campaign, low, end + plan.longest)[1]
                at = np.arange(low, base + 1) if base else np.array([0])
                passed = np.zeros(len(at), np.int64)
                while (go := after[at - low] <= end).any():
                    at, passed = np.where(go, after[at - low], at), passed + go
                out.append((campaign, stretch, low, at.tolist(), passed.tolist()))
            yield pd.DataFrame(out, columns=["key", "stretch", "low", "at", "passed"])

    made = stretches.repartition("key", "stretch").mapInPandas(functions, "key string, stretch bigint, low bigint, at array<bigint>, passed array<bigint>")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        campaign, begun, day = None, 0, 0
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if row.key != campaign:
                    campaign, begun, day = row.key, 0, 0
                out.append((campaign, row.stretch, begun, day))
                k = begun - row.low
                begun, day = int(row.at[k]), day + int(row.passed[k])
            yield pd.DataFrame(out, columns=["key", "stretch", "begun", "day"])

    opened = made.repartition("key").sortWithinPartitions("key", "stretch").mapInPandas(chain, "key string, stretch bigint, begun bigint, day bigint")

    number = F.col("__place") - F.col("__first")
    same = F.col("campaign_id").eqNullSafe(F.col("__c"))
    placed = rows.join(firsts.withColumnRenamed("campaign_id", "__c"), same).select(*own, key.alias("key"), number.alias("n"), F.floor(number / size).alias("stretch"))
    filled = placed.join(saved(opened, "stretches"), ["key", "stretch"]).sortWithinPartitions("key", "stretch", "n")
    kinds = dict(recipients.dtypes)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, starts, passed, low = None, None, None, 0
        for batch in batches:
            seconds = np.zeros(len(batch), np.int64)
            keys, stretches, ns = batch["key"].to_numpy(), batch["stretch"].to_numpy(), batch["n"].to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (stretches[1:] != stretches[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(batch)], strict=True):
                if a == b:
                    continue
                first = batch.iloc[a]
                if now != (first["key"], first["stretch"]):
                    now, low = (first["key"], first["stretch"]), int(first["begun"])
                    high = int(first["stretch"]) * size + size
                    passed, after = plan.days(first["key"], low, high)
                    days = [low]
                    while (nxt := int(after[days[-1] - low])) <= high:
                        days.append(nxt)
                    starts = np.array(days)
                n = ns[a:b]
                k = np.searchsorted(starts, n, "right") - 1
                dates = np.busday_offset(plan.first_day, int(first["day"]) + k, weekmask=plan.mask)
                at = passed[n - low] - passed[starts[k] - low] + np.where(starts[k] == 0, plan.lead, 0)
                seconds[a:b] = dates.astype("datetime64[s]").astype(np.int64) + plan.start_hour * 3600 + at
            out = batch[own].copy()
            out["at"] = seconds
            yield out

    schema = ", ".join(f"{c} {kinds[c]}" for c in own) + ", at bigint"
    local = F.timestamp_seconds("at")
    return filled.mapInPandas(fill, schema).select(*own, F.to_utc_timestamp(local, zone).alias("send_at"))
