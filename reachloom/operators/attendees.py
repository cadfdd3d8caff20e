"""People who took part in events of given companies, as their posts tell, with their profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import any_term
from ..functions.taxonomy import term_hits
from ..functions.text import text_of
from ..storage import saved
from .profiles import parse_profiles, profile_location
from .signals import assess_signal, event_participants


def take_in_turn(choices: DataFrame) -> DataFrame:
    """who, what: each taker gets the first of its choices that no taker before it has. choices: who (the order of takers),
    pick (the order of a taker's choices), what, good. A taker whose first free choice isn't good gets nothing, and a choice
    that isn't good is never taken.

    In each round every taker without a thing names its first choice left, and a thing goes to the first of those who name it
    or hold it; what it was refused by, a taker doesn't name again. Takers before decide alone, so this ends in the same
    result as one after the other, and a round settles all takers that don't compete. No table is sent whole: each can be
    as large as the choices.
    """
    left = saved(choices.select("who", "pick", "what", "good"), "choices")
    while True:
        asked = left.groupBy("who").agg(F.min(F.struct("pick", "what", "good")).alias("c")).select("who", "c.*")
        firsts = asked.where("good").groupBy("what").agg(F.min("who").alias("winner"))
        refused = asked.where("good").join(firsts.hint("merge"), "what").where("who != winner").select("who", "what")
        now = saved(left.join(refused.hint("merge"), ["who", "what"], "left_anti"), "choices")
        if not refused.take(1):
            return asked.where("good").select("who", "what")
        left = now


def event_attendees(
    posts: DataFrame, profiles: DataFrame, direct: DataFrame, roles: list[str], places: list[str], asked: list[str] | None = None, known: DataFrame | None = None, most: int | None = None
) -> DataFrame:
    """Url, name, designation, company, place (Yes or Check), source, bucket, signal, score: people whom posts (source,
    source_no, post, text) name as taking part (X15), each with the first profile (profile, title, href, body) whose text has
    the name's first two words and that isn't known or taken; kept if its role or place fits. Then, source by source, direct
    results (source, source_no, row, title, href, body) whose role, place and signal all fit. In that order, `most` at most.
    """
    parsed = lambda df, key: saved(
        parse_profiles(df).where("url IS NOT NULL").withColumns({
            "fits": any_term(F.col("designation"), roles) if roles else F.lit(True),
            "there": profile_location(F.col("body"), F.col("title"), places) != "",
        }), key)
    found, own = parsed(profiles, "profiles"), parsed(direct, "direct")
    if known is not None:
        found, own = (x.join(known.select("url").hint("merge"), "url", "left_anti") for x in (found, own))
    told = event_participants(posts, "post", "text", asked).join(posts.select("post", "source", "source_no").hint("merge"), "post")
    once = F.row_number().over(Window.partitionBy("source_no", F.lower("name")).orderBy("post", "pos"))
    told = saved(told.withColumn("n", once).where("n = 1").withColumn("two", F.substring_index(F.regexp_replace("name", r"\s+", " "), " ", 2)), "told")
    texts = found.select("profile", F.concat_ws(" ", text_of(F.col("title")), text_of(F.col("body"))).alias("text"))
    hits = term_hits(texts, "profile", "text", told.select(F.col("two").alias("term")).distinct())
    who = F.struct(F.col("source_no"), F.lit(0).alias("part"), F.col("post").cast("bigint").alias("a"), F.col("pos").cast("bigint").alias("b"))
    named = told.join(hits.withColumnRenamed("term", "two").hint("merge"), "two").join(found.hint("merge"), "profile")
    named = saved(named.select(who.alias("who"), F.col("profile").alias("pick"), F.col("url").alias("what"), (F.col("fits") | F.col("there")).alias("good")), "named")
    signals = assess_signal(own.select("row", "title", "body", F.col("name").alias("person")), "row", asked).where("name != 'No Verified Signal' AND selected_match")
    sure = own.where("fits AND there").join(signals.select("row", F.col("name").alias("signal"), "score").hint("merge"), "row")
    alone = F.struct(F.col("source_no"), F.lit(1).alias("part"), F.col("row").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    offers = named.unionByName(sure.select(alone.alias("who"), F.lit(0).cast("bigint").alias("pick"), F.col("url").alias("what"), F.lit(True).alias("good")))
    taken = take_in_turn(offers).hint("merge")
    picked = taken.where("who.part = 0").withColumnRenamed("what", "url").join(named.select("who", F.col("what").alias("url"), F.col("pick").alias("profile")), ["who", "url"])
    picked = picked.groupBy("who", "url").agg(F.min("profile").alias("profile")).join(found.drop("url").hint("merge"), "profile")
    of = told.select(who.alias("who"), "source", "signal", "score", F.col("name").alias("said"))
    shown = F.when(F.col("there"), "Yes").otherwise("Check").alias("place")
    people = picked.join(of.hint("merge"), "who").select("who", "url", F.coalesce(F.nullif("name", F.lit("")), "said").alias("name"), "designation", "company", shown, "source", F.lit("named").alias("bucket"), "signal", "score")
    straight = taken.where("who.part = 1").select("who", F.col("what").alias("url")).hint("merge").join(
        sure.select(alone.alias("who"), "name", "designation", "company", shown, "source", F.lit("direct").alias("bucket"), "signal", "score"), "who")
    out = people.unionByName(straight.select(*people.columns))
    return (out.orderBy("who").limit(most) if most is not None else out).drop("who")
