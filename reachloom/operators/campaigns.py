"""Campaigns: recipients taken from lists, admitted, given messages, suppressed; states and reports.

A recipient row has id, campaign_id, email, full_name, first_name, company, designation, profile_url, source_data (map),
status, response_classification and times. A message event has id, campaign_id, recipient_id, event_type, occurred_at.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import first_reason
from ..functions.text import normalize_email, template_key, text_of

# Fixed values of the data rules.
SAFE = "SAFE TO CONTACT"
UNSENT = ("CANCELLED", "FAILED", "SKIPPED_SUPPRESSED")
NOT_HISTORY = ("DRAFT", "QUEUED", "CANCELLED", "SKIPPED_SUPPRESSED")
TOKEN = re.compile(r"\{\{\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\}\}")
RECIPIENT_COLUMNS = (
    "id", "campaign_id", "email", "full_name", "first_name", "company", "designation", "profile_url", "status",
    "response_classification", "open_count", "first_opened_at", "last_opened_at", "click_count", "first_clicked_at",
    "last_clicked_at", "replied_at", "bounced_at", "unsubscribed_at", "scheduled_at", "created_at",
)


def intake(df: DataFrame, mapping: dict[str, str], order: str = "seq", confirmed_safe: bool = False) -> DataFrame:
    """Rows with reason (empty: taken), email, full_name and first_name. mapping: field -> column; decision names a
    column that has to say SAFE TO CONTACT, without one the whole list has to be confirmed safe. An address is taken
    once, at its first valid row."""
    if mapping.get("email", "") not in df.columns:
        raise ValueError("Map a column containing recipient email addresses")
    get = lambda f: F.trim(text_of(F.col(f"`{mapping[f]}`"))) if mapping.get(f) in df.columns else F.lit("")
    if mapping.get("decision"):
        safe = ("not_safe_to_contact", F.upper(get("decision")) != SAFE)
    else:
        safe = ("safe_status_not_confirmed", F.lit(not confirmed_safe))
    made = df.withColumns({"__email": normalize_email(get("email")), "__name": get("full_name"), "__first": get("first_name")})
    made = made.withColumn("__why", first_reason([("invalid_or_blank_email", F.col("__email") == ""), safe]))
    firsts = made.where("__why = ''").groupBy(F.col("__email").alias("__e")).agg(F.min(order).alias("__at"))
    made = made.join(firsts, (F.col("__email") == F.col("__e")) & (F.col("__why") == ""), "left")
    reason = F.when(F.col(order) > F.col("__at"), "duplicate_email_in_source").otherwise(F.col("__why"))
    whole = F.when(F.col("__name") != "", F.col("__name")).otherwise(F.trim(F.concat_ws(" ", "__first", get("last_name"))))
    first = F.when(F.col("__first") != "", F.col("__first")).otherwise(F.substring_index(whole, " ", 1))
    given = get("email")
    return made.select(
        F.col(order), reason.alias("reason"), F.when(reason == "", F.col("__email")).otherwise(given).alias("email"),
        F.when(reason == "", whole).otherwise(F.col("__name")).alias("full_name"), F.when(reason == "", first).otherwise("").alias("first_name"),
        *[get(f).alias(f) for f in ("company", "designation")],
    )


def admit(candidates: DataFrame, suppressed: DataFrame, recipients: DataFrame, order: str = "seq") -> DataFrame:
    """Candidates with reason (empty: admitted): no address, suppressed (email), in the campaign history (recipients
    neither unsent nor allowed again), or a repeated address."""
    made = candidates.withColumn("__e", normalize_email(F.col("email")))
    gone = suppressed.select(normalize_email(F.col("email")).alias("__s"), F.lit(True).alias("__gone")).distinct()
    old = recipients.where(~F.col("status").isin(*UNSENT) & (F.col("response_classification") != "RECONTACT_ALLOWED"))
    old = old.select(normalize_email(F.col("email")).alias("__o"), F.lit(True).alias("__old")).distinct()
    made = made.join(gone, F.col("__e") == F.col("__s"), "left").join(old, F.col("__e") == F.col("__o"), "left")
    why = first_reason([
        ("invalid_email", F.col("__e") == ""), ("suppressed", F.coalesce("__gone", F.lit(False))),
        ("already_in_campaign_history", F.coalesce("__old", F.lit(False))),
    ])
    made = made.withColumn("__why", why)
    firsts = made.where("__why = ''").groupBy(F.col("__e").alias("__f")).agg(F.min(order).alias("__at"))
    made = made.join(firsts, (F.col("__e") == F.col("__f")) & (F.col("__why") == ""), "left")
    reason = F.when(F.col(order) > F.col("__at"), "duplicate_email_in_campaign").otherwise(F.col("__why"))
    return made.withColumn("reason", reason).select(*candidates.columns, "reason")


def recipient_context(source_data: str = "source_data") -> Column:
    """The row's own columns under template keys (the first of equal keys), overlaid by the known fields."""
    pairs = F.transform(F.map_entries(F.coalesce(F.col(source_data), F.create_map().cast("map<string,string>"))),
                        lambda e: F.struct(template_key(e.key).alias("key"), F.coalesce(e.value, F.lit("")).alias("value")))
    name = F.trim(text_of(F.col("full_name")))
    first = F.trim(text_of(F.col("first_name")))
    known = {
        "email": text_of(F.col("email")), "name": name, "full_name": name,
        "first_name": F.when(first != "", first).otherwise(F.substring_index(name, " ", 1)),
        "company": text_of(F.col("company")), "designation": text_of(F.col("designation")), "linkedin_url": text_of(F.col("profile_url")),
    }
    fixed = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in known.items()])
    own = F.filter(pairs, lambda p: ~p.key.isin(*known))
    fresh = F.aggregate(own, F.slice(own, 1, 0), lambda acc, p: F.when(F.exists(acc, lambda q: q.key == p.key), acc).otherwise(F.array_append(acc, p)))
    return F.map_from_entries(F.concat(fresh, fixed))


def template_tokens(*templates: str) -> list[str]:
    """Placeholder names; anything else that looks like template code is an error."""
    found: set[str] = set()
    for t in templates:
        if any(m in TOKEN.sub("", t or "") for m in ("{{", "{%", "{#")):
            raise ValueError("Templates support only simple placeholders such as {{first_name}}")
        found.update(TOKEN.findall(t or ""))
    return sorted(found)


def missing_tokens(context: Column, *templates: str) -> Column:
    """The placeholders that have no value, sorted."""
    names = F.array(*map(F.lit, template_tokens(*templates))) if template_tokens(*templates) else F.array().cast("array<string>")
    return F.filter(names, lambda t: F.trim(F.coalesce(context[t], F.lit(""))) == "")


def render(template: str, context: Column, html: bool = False) -> Column:
    """The template with its placeholders filled; values are escaped in html. A missing key is an error."""
    template_tokens(template)

    def value(name: str) -> Column:
        v = F.when(F.map_contains_key(context, F.lit(name)), context[name]).otherwise(F.raise_error(F.lit(f"'{name}' is undefined")).cast("string"))
        if html:
            for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
                v = F.replace(v, F.lit(a), F.lit(b))
        return v

    parts, at = [], 0
    for m in TOKEN.finditer(template):
        parts += [F.lit(template[at : m.start()]), value(m[1])]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def messages(recipients: DataFrame, subject: str, html: str, text: str, slots: DataFrame) -> DataFrame:
    """One queued message for each recipient that isn't sent yet and has a slot (id, send_at): subject, html and text
    as they read now, with the time to send. Recipients already past QUEUED keep their message."""
    waiting = recipients.where(F.col("status").isin("DRAFT", "QUEUED")).withColumn("__context", recipient_context())
    made = waiting.join(slots.select(F.col("id").alias("__id"), "send_at"), F.col("id") == F.col("__id"))
    context = F.col("__context")
    return made.select(
        "id", "campaign_id", "email", render(subject, context).alias("subject"), render(html, context, html=True).alias("html"),
        render(text, context).alias("text"), F.col("send_at").alias("scheduled_at"), F.lit("QUEUED").alias("status"),
    )


def suppress(recipients: DataFrame, requests: DataFrame, suppressed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new suppression rows, recipients after it). requests: recipient_id, at, reason, source. An address already
    suppressed keeps its entry; the first request of an address makes it; unsubscribed_at stays the earliest."""
    asked = requests.join(recipients.select(F.col("id").alias("recipient_id"), normalize_email(F.col("email")).alias("email")), "recipient_id")
    new = asked.groupBy("email").agg(F.min_by(F.struct("reason", "source", "at"), "at").alias("x")).select("email", "x.*")
    new = new.join(suppressed.select("email"), "email", "left_anti")
    when = requests.groupBy(F.col("recipient_id").alias("__r")).agg(F.min("at").alias("__at"))
    after = recipients.join(when, F.col("id") == F.col("__r"), "left")
    hit = F.col("__at").isNotNull()
    return new, after.withColumns({
        "status": F.when(hit, "UNSUBSCRIBED").otherwise(F.col("status")),
        "response_classification": F.when(hit, "DO_NOT_CONTACT").otherwise(F.col("response_classification")),
        "unsubscribed_at": F.least("unsubscribed_at", "__at"),
    }).select(*recipients.columns)


def transition(campaigns: DataFrame, recipients: DataFrame, action: str) -> tuple[DataFrame, DataFrame]:
    """(campaigns, recipients) after pause, resume, cancel or complete; campaigns have id and status."""
    state = F.col("status")
    if action == "pause":
        return campaigns.withColumn("status", F.when(state.isin("SCHEDULED", "RUNNING"), "PAUSED").otherwise(state)), recipients
    if action == "resume":
        return campaigns.withColumn("status", F.when(state == "PAUSED", "SCHEDULED").otherwise(state)), recipients
    if action == "cancel":
        open_ = campaigns.where(~state.isin("COMPLETED", "CANCELLED")).select(F.col("id").alias("__c"))
        cut = recipients.join(open_, F.col("campaign_id") == F.col("__c"), "left")
        now = F.when(F.col("__c").isNotNull() & state.isin("DRAFT", "QUEUED"), "CANCELLED").otherwise(state)
        return campaigns.withColumn("status", F.when(state == "COMPLETED", state).otherwise("CANCELLED")), cut.withColumn("status", now).drop("__c")
    if action == "complete":
        busy = recipients.where(state.isin("QUEUED", "SENDING")).select(F.col("campaign_id").alias("__c")).distinct()
        made = campaigns.join(busy, F.col("id") == F.col("__c"), "left")
        done = state.isin("SCHEDULED", "RUNNING") & F.col("__c").isNull()
        return made.withColumn("status", F.when(done, "COMPLETED").otherwise(state)).drop("__c"), recipients
    raise ValueError(f"no such action: {action}")


def campaign_history(recipients: DataFrame) -> DataFrame:
    """Recipients that were written to, as rows of a previous source."""
    never = F.col("status").isin("UNSUBSCRIBED", "BOUNCED")
    return recipients.where(~F.col("status").isin(*NOT_HISTORY)).select(
        "id", "email", "full_name", "company", F.when(never, "Do not contact").otherwise("Contacted").alias("status"))


def iso(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def recipients_view(recipients: DataFrame) -> DataFrame:
    """The report of recipients: RECIPIENT_COLUMNS, times as ISO text, what is missing empty."""
    have = dict(recipients.dtypes)
    columns = []
    for c in RECIPIENT_COLUMNS:
        if c not in have:
            columns.append(F.lit("").alias(c))
        elif have[c].startswith("timestamp"):
            columns.append(iso(F.col(c)).alias(c))
        else:
            columns.append((F.coalesce(F.col(c), F.lit("")) if have[c] == "string" else F.col(c)).alias(c))
    return recipients.select(*columns)


def events_view(events: DataFrame) -> DataFrame:
    """The report of events."""
    return events.select("id", "campaign_id", "recipient_id", "event_type", iso(F.col("occurred_at")).alias("occurred_at"))


def campaign_sheets(campaigns: DataFrame, recipients: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """M09."""
    report = recipients_view(recipients)
    only = lambda *s: report.where(F.col("status").isin(*s))
    return {
        "Recipients": report, "Events": events_view(events), "Replies": only("REPLIED"), "Failures and bounces": only("FAILED", "BOUNCED"),
        "Unsubscribes": only("UNSUBSCRIBED"), "Configuration": campaigns,
    }


def expired_leases(recipients: DataFrame, now: Column) -> DataFrame:
    """Messages whose sender has gone: SENDING with leased_until before now are queued for now."""
    gone = (F.col("status") == "SENDING") & (F.col("leased_until") < now)
    return recipients.withColumns({
        "status": F.when(gone, "QUEUED").otherwise(F.col("status")), "scheduled_at": F.when(gone, now).otherwise(F.col("scheduled_at")),
    })


def recipient_state(events: DataFrame) -> DataFrame:
    """Opens, clicks, first and last times and the status of each recipient after its events in order (by time, then
    id). OPENED moves only SENT on, CLICKED moves SENT and OPENED; a reply, bounce or unsubscription always counts, so
    the last of them stands unless an unsubscription came before it and a message was never sent again.

    The last of REPLIED, BOUNCED and UNSUBSCRIBED is a maximum, and openings or clicks change nothing after one: all
    parts are counts, minima and maxima that combine before the shuffle, whatever a recipient's number of events.
    """
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("occurred_at"))
    final = F.max(F.when(F.col("event_type").isin("REPLIED", "BOUNCED", "UNSUBSCRIBED"), F.struct("occurred_at", "id", "event_type")))
    grouped = events.groupBy("recipient_id").agg(
        *[f(at(k)).alias(f"{n}_{w}") for k, n in (("OPENED", "open"), ("CLICKED", "click"))
          for f, w in ((F.count, "count"), (F.min, "first"), (F.max, "last"))],
        F.max(F.when(F.col("event_type").isin("BOUNCED", "UNSUBSCRIBED"), True)).alias("__never"), final.alias("__final"),
    )
    status = F.when(F.col("__final").isNotNull(), F.col("__final.event_type")).when(F.col("click_count") > 0, "CLICKED").when(
        F.col("open_count") > 0, "OPENED").otherwise("SENT")
    return grouped.select(
        "recipient_id", "open_count", F.col("open_first").alias("first_opened_at"), F.col("open_last").alias("last_opened_at"),
        "click_count", F.col("click_first").alias("first_clicked_at"), F.col("click_last").alias("last_clicked_at"),
        status.alias("status"), F.coalesce("__never", F.lit(False)).alias("suppressed"),
    )


def mailbox_event(sender: Column, subject: Column, own: Column) -> Column:
    """Bounce, reply, or empty for the account's own mail."""
    text = F.lower(F.concat_ws(" ", text_of(sender), text_of(subject)))
    marks = ("mailer-daemon", "postmaster", "delivery status notification", "undeliverable")
    bounce = reduce(lambda a, b: a | b, [text.contains(m) for m in marks])
    mine = F.contains(F.lower(text_of(sender)), F.lower(text_of(own))) & (text_of(own) != "")
    return F.when(mine, "").when(bounce, "bounce").otherwise("reply")


def retry_queue(attempts: DataFrame) -> DataFrame:
    """Failed tasks without any success: attempted and failed sources (in the order of their first try), the last
    source and reason, whether a challenge came up, and the most attempts. attempts: seq, task, query, source, ok,
    reason, challenge, attempt."""
    won = attempts.where("ok").select("task", "query").distinct()
    lost = attempts.join(won, ["task", "query"], "left_anti")
    per = lost.groupBy("task", "query", "source").agg(
        F.min("seq").alias("first"), F.max(F.struct("seq", "reason")).alias("last"), F.max("challenge").alias("challenge"), F.max("attempt").alias("attempt"))
    inorder = F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x.source)  # one for each source
    newest = F.max(F.struct("last", "source"))
    return per.groupBy("task", "query").agg(
        F.array_join(inorder, ", ").alias("sources"), newest.alias("x"), F.max("challenge").alias("challenge"), F.max("attempt").alias("attempts"),
    ).select("task", "query", "sources", F.col("x.source").alias("last_source"), F.col("x.last.reason").alias("reason"), "challenge", "attempts")


def resume(work: DataFrame, unit: str, finished: DataFrame, cursor: str) -> DataFrame:
    """What is left to do: rows after the last finished cursor, and earlier ones of units that never finished."""
    units = finished.select(unit).distinct()
    last = finished.agg(F.max(cursor).alias("__last"))  # one row
    rows = work.join(units.withColumn("__done", F.lit(True)), unit, "left").crossJoin(F.broadcast(last))
    return rows.where(F.col("__last").isNull() | (F.col(cursor) > F.col("__last")) | F.col("__done").isNull()).drop("__done", "__last")
