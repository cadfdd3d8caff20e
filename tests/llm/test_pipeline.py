"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reachloom.llm import decontaminate, toxicity
from reachloom.llm.common import saved
from reachloom.storage import trim_driver

from test_operators import pairs, water_levels

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def runs(spark):
    """Input and output of every stage; a row of the input has a null text, and one an id of another text."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = docs.limit(1)
    docs = docs.unionByName(one.withColumn("text", F.lit(None).cast("string"))).unionByName(one.withColumn("text", F.lit("quite another text")))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = saved(stage(spark, docs, SMALL), f"stage-{name}")
        out[name] = docs, made
        docs = made
    return out


def test_stages_give_the_drivers_unused_memory_back(spark, monkeypatch):
    """Each stage asks for it before it plans anything."""
    said = []
    monkeypatch.setattr(corpus_pipeline, "trim_driver", lambda s: said.append(trim_driver(s)))
    made = corpus_pipeline.stage(lambda s, docs, sf_dir: docs)
    made(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert len(said) == 1 and "heap" in said[0].lower()


def rows(df):
    return Counter(pairs(df))


def test_columns(runs):
    for name, (before, after) in runs.items():
        assert after.columns == before.columns + ["copy"] * (name == "mixing")
        assert 0 < after.count()


def test_toxic_documents_go(runs, spark):
    before, after = runs["toxicity"]
    index = toxicity.train(before, spark.read.parquet(f"{SMALL}/labels.parquet"), F.lit(True))
    want = Counter((r["doc_id"], r["text"]) for r in toxicity.score(before, index).collect() if r["score"] < 0.7)
    assert rows(after) == want


def test_one_of_each_group_stays(runs):
    before, after = runs["near_dedup"]
    all_rows = pairs(before)
    want = Counter()
    least = {}
    sets = near_components(all_rows)
    for (i, t), c in zip(all_rows, sets):
        least[c] = min(least.get(c, i), i)
    for (i, t), c in zip(all_rows, sets):
        if least[c] == i:
            want[(i, t)] += 1
    assert rows(after) == want


def near_components(all_rows):
    """A component number for each row: texts linked from 0.8 on, by five words."""
    sets = []
    for _, t in all_rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(all_rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(all_rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(all_rows))]


def test_repeated_passages_go(runs):
    before, after = runs["substring_dedup"]
    split = [(i, t, (t or "").encode().split()) for i, t in pairs(before)]
    first = {}
    for i, _, w in split:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        if not any(gone):
            want[(i, t)] += 1
        elif not all(gone):
            want[(i, b" ".join(x for x, g in zip(w, gone) if not g).decode())] += 1
    assert rows(after) == want


def test_contaminated_documents_go(runs, spark):
    before, after = runs["decontamination"]
    patterns = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = decontaminate.words((r["text"] or "").encode())
        n = min(10, len(w))
        patterns |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    lengths = {len(p) for p in patterns}

    def clean(t):
        w = decontaminate.words((t or "").encode())
        return not any(tuple(w[k : k + n]) in patterns for n in lengths for k in range(len(w) - n + 1))

    assert rows(after) == Counter((i, t) for i, t in pairs(before) if clean(t))


def test_sources_are_mixed(runs):
    before, after = runs["mixing"]
    size = lambda t: len((t or "").encode().split())
    have, taken, longest = Counter(), Counter(), 0
    for r in before.collect():
        have[r["source"]] += size(r["text"])
        longest = max(longest, size(r["text"]))
    copies = defaultdict(list)
    for r in after.collect():
        taken[r["source"]] += size(r["text"])
        copies[r["doc_id"], r["text"]].append(r["copy"])
    names = sorted((s for s in have if s is not None), key=lambda s: s.encode()) + [None] * (None in have)
    want = water_levels(have, {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}, 1.5 * sum(have.values()))
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 2 for c in copies.values())
    assert all(want[s] - longest <= taken[s] <= want[s] + 1e-6 for s in have)
