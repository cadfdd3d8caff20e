"""Fuzzy matching takes the best name and the best company over all records of a cluster; alike names against all pairs."""

import random

import pytest

from reachloom.operators import identity as I

HISTORY = [
    (1, "ann lee", ""), (1, "a l", "acme"),  # the company stands on another record
    (2, "lee bob", ""), (2, "bob x", "acme"),  # the alike name shares neither the first letter nor the last word
    (3, "ann lea", "other"),
]


def test_best_of_a_cluster(spark):
    history = spark.createDataFrame(HISTORY, "cluster bigint, name_key string, company_key string")
    primary = spark.createDataFrame([(10, "anne lee", "acme"), (11, "bob lee", "acme")], "seq bigint, name_key string, company_key string")
    got = {(r["seq"], r["cluster"]): (r["name_score"], r["company_score"]) for r in I.match_fuzzy(primary, history).collect()}
    assert got == {(10, 1): (93, 100), (11, 2): (100, 100)}


def ratio(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[-1]))
    return round(200 * row[-1] / (len(a) + len(b)))


@pytest.mark.parametrize("least", [90, 95, 80])
def test_similar_names_are_those_of_all_pairs(spark, least):
    rng = random.Random(least)
    base = ["ann lee", "maximilian oberholzer", "bo", "x", "aaaaaaaaaa", "abababab cdcd", "li wei zhang", "josé núñez", "ab cd ef gh ij kl mn op", "a" * 30]

    def typo(s):
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(s) + 1)
            s = rng.choice([s[:k] + rng.choice("abelo ") + s[k:], s[: max(k - 1, 0)] + s[k:], s])
        w = s.split()
        rng.shuffle(w)
        return " ".join(w) or "z"

    left = [typo(rng.choice(base)) for _ in range(60)] + base
    right = [typo(rng.choice(base)) for _ in range(60)] + base
    got = I.similar_names(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), least)
    want = {(a, b, s) for a in set(left) for b in set(right) if (s := ratio(a, b)) >= least}
    assert {(r["a"], r["b"], int(r["score"])) for r in got.collect()} == want and len(want) > 60


def join_rows(plan):
    """Rows that the joins of an executed plan have given."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return join_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return join_rows(plan.plan())
    rows = plan.metrics().apply("numOutputRows").value() if kind.endswith("JoinExec") else 0
    return rows + sum(join_rows(plan.children().apply(k)) for k in range(plan.children().size()))


def test_names_with_common_words_meet_few_others(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    right = sorted({f"{rng.choice(['large', 'small', 'blue', 'hot'])} {rng.choice(['ring', 'bolt', 'gear', 'widget'])} {word()}" for _ in range(4000)})
    left = [f"{n[:-1]}{'b' if n[-1] == 'a' else 'a'}" for n in right[::100]] + ["large ring abcdefj", "hot bolt abcdj"]
    got = I.similar_names(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"))
    found = {(r["a"], r["b"], int(r["score"])) for r in got.collect()}
    assert found == {(a, b, s) for a in left for b in right if (s := ratio(a, b)) >= 90} and len(found) >= 40
    # a share of all pairs, not most of them
    assert join_rows(got._jdf.queryExecution().executedPlan()) < len(left) * len(right) / 10
