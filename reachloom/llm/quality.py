"""Host-level quality rules, with DataFrame functions only.

Each text is measured and judged by RULES. Each rule's failures are counted by host (here the column `source`); the
hosts' failure rates are shrunk towards what all hosts do with a beta prior, fitted to the hosts' rates by moments, one
for each rule. A host is rejected with all its documents if for some rule its shrunk rate is both over an absolute limit
and far out in the prior: more than `host_spread` of the prior's standard deviations over its mean.

Cases: a null or empty text has no words and fails the base rules. A null host is a host of its own. Repeated rows
count as often as they occur and all come back. An empty table gives an empty result. Other columns are carried
along; one that has the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_SPLIT, saved

WINDOW = 8


def words_of(text: Column) -> Column:
    """Words parted by ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_SPLIT), lambda w: w != "")


#: Hashes of the windows of eight words by their first word: pairs, then fours, then eights of word hashes. The
#: one-element arrays bind each level once. Two different windows of one text share a 64-bit hash with a
#: probability of about the square of its number of windows / 2^65.
WINDOW_HASHES = (
    "transform(transform(transform(array(transform(__w, x -> xxhash64(x))),"
    " h -> transform(h, (x, i) -> xxhash64(x, get(h, i + 1)))),"
    " h -> transform(h, (x, i) -> xxhash64(x, get(h, i + 2)))),"
    f" h -> transform(slice(h, 1, __n - {WINDOW - 1}), (x, i) -> xxhash64(x, get(h, i + 4))))[0]"
)

#: Words in windows whose hash equals a neighbour's in sorted order: the sum of the steps between those windows'
#: positions, each at most a window long.
COVERED = (
    "transform(transform(array(array_sort(transform(__h, (x, i) -> struct(x AS a, i AS i)))),"
    " s -> array_sort(transform(filter(sequence(0, size(s) - 1),"
    " j -> (j > 0 AND s[j].a = s[greatest(j - 1, 0)].a)"
    " OR (j < size(s) - 1 AND s[j].a = s[least(j + 1, size(s) - 1)].a)), j -> s[j].i))),"
    f" p -> aggregate(p, named_struct('last', -{WINDOW}, 'sum', 0L),"
    f" (acc, i) -> named_struct('last', i, 'sum', acc.sum + least({WINDOW}, i - acc.last)), acc -> acc.sum))[0]"
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each whole text.

    Most texts repeat no window: only those with two equal window hashes are sorted by window.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c not in new and c != text]
    t = F.coalesce(F.col("__t"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = docs.select(*kept, F.col(text).cast("string").alias("__t")).withColumn("__w", words_of(F.col("__t")))
    hashed = words.withColumn("__n", F.size("__w")).withColumn(
        "__h", F.when(F.col("__n") > WINDOW, F.expr(WINDOW_HASHES)))
    return hashed.select(
        *kept,
        F.col("__t").alias(text),
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.expr(COVERED))
        .otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


#: Rules by name, true where a measured document fails; the first two are the base rules, which it fails by itself.
RULES = {
    "few_words": "n_words < {min_words}",
    "repeats": "100 * n_repeat_words > {max_repeat_percent} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "repeated_lines": "n_dup_lines > 0.3 * n_lines",
}
BASE_RULES = ("few_words", "repeats")


def host_verdicts(failures: DataFrame, limit: float, spread: float, least_docs: int) -> DataFrame:
    """One row for each host: host_docs, host_rate and host_rule (the greatest shrunk rate and its rule), and whether
    the host is rejected. failures: __host, and a boolean column for each rule.

    A rule's prior has the mean over all documents; its weight in documents comes from the spread of the hosts' rates
    beyond what chance gives (method of moments, between 2 and 1,000). A host with fewer than least_docs documents is
    never rejected.
    """
    rules = [c for c in failures.columns if c != "__host"]
    hosts = failures.groupBy("__host").agg(
        F.count(F.lit(1)).alias("host_docs"), *[F.sum(F.col(c).cast("long")).alias(c) for c in rules])
    rates = saved(
        hosts.select(
            "__host", "host_docs",
            F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("failed")) for c in rules])).alias("x"),
        ).select("__host", "host_docs", "x.*"),
        "host-failures",
    )
    prior = rates.groupBy(F.col("rule").alias("__rule")).agg(
        (F.sum("failed") / F.sum("host_docs")).alias("__mean"),
        F.coalesce(F.var_samp(F.col("failed") / F.col("host_docs")), F.lit(0.0)).alias("__var"),
        F.avg(F.lit(1.0) / F.col("host_docs")).alias("__inv"),
    )
    within = F.col("__mean") * (1 - F.col("__mean"))
    between = F.greatest(F.col("__var") - within * F.col("__inv"), F.lit(1e-9))
    prior = prior.withColumn("__weight", F.greatest(F.lit(2.0), F.least(F.lit(1000.0), within / between - 1)))
    prior = prior.withColumn("__far", F.col("__mean") + spread * F.sqrt(within / (F.col("__weight") + 1)))
    shrunk = (F.col("failed") + F.col("__mean") * F.col("__weight")) / (F.col("host_docs") + F.col("__weight"))
    judged = rates.join(F.broadcast(prior), F.col("rule") == F.col("__rule")).withColumn("rate", shrunk)  # a row for each rule
    bad = (F.col("rate") > limit) & (F.col("rate") > F.col("__far")) & (F.col("host_docs") >= least_docs)
    worst = F.max(F.struct("rate", "rule"))
    return saved(
        judged.groupBy("__host").agg(F.first("host_docs").alias("host_docs"), worst.alias("x"), F.max(bad).alias("__host_rejected")).select(
            "__host", "host_docs", F.col("x.rate").alias("host_rate"), F.col("x.rule").alias("host_rule"), "__host_rejected"),
        "host-verdicts",
    )


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    host_limit: float = 0.5,
    host_spread: float = 3.0,
    host_least_docs: int = 20,
    with_text: bool = False,
) -> DataFrame:
    """docs with the measures, base_failed, host_rate, host_rule and kept.

    base_failed: fewer than min_words words, or over max_repeat_percent of the words in repeated windows. kept is
    false for failed documents and for all documents of a rejected host: a clean document goes only if most of what its
    host publishes fails one of the rules, and other hosts don't fail it as often.
    """
    measured = measures(docs, text)
    if not with_text:
        measured = measured.drop(text)
    limits = {"min_words": min_words, "max_repeat_percent": max_repeat_percent}
    failed = {name: F.expr(rule.format(**limits)) for name, rule in RULES.items()}
    base = failed[BASE_RULES[0]] | failed[BASE_RULES[1]]
    measured = measured.withColumn("base_failed", base)
    if host not in measured.columns:
        measured = measured.withColumn(host, F.lit(None).cast("string"))
    measured = saved(measured, "quality")  # measured once, read twice
    failures = measured.select(F.col(host).alias("__host"), *[c.alias(n) for n, c in failed.items()])
    verdicts = host_verdicts(failures, host_limit, host_spread, host_least_docs).drop("host_docs")
    rest = [c for c in measured.columns if c not in ("host_rate", "host_rule", "kept")]
    return (
        measured.select(*rest)
        .join(verdicts, F.col(host).eqNullSafe(F.col("__host")), "left")
        .select(*rest, "host_rate", "host_rule", (~F.col("base_failed") & ~F.col("__host_rejected")).alias("kept"))
    )
