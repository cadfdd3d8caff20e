"""Benchmark decontamination by Wu-Manber search for many patterns at once, over words.

The patterns are the windows of `window` consecutive words of every benchmark item (an item of fewer words, but not
none, is one shorter window). For each pattern length there is a shift table keyed by blocks of two words: it says how
far the search may move on when a block ends the current window, and a block that no pattern holds allows the longest
move. Where the shift is zero, the block picks the bucket of patterns that end with it, and comparing words confirms.

Benchmarks of any size work: items are dealt into parts of bounded size by a hash of their id and text, each part's
tables are broadcast (PART_BYTES of text at most on average), the documents are searched once for each part, and the
hits are united.

Cases: a null or empty text has no words and is never contaminated. A null item text gives no window; a null item_id is
named "null". Repeated items count once by id. Repeated documents each get their row. An empty benchmark hits nothing.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate

#: Lower-case letters, digits and everything that isn't ASCII, as UTF-8 bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Benchmark text in one broadcast part.
PART_BYTES = 8 << 20


def words(text: bytes | None) -> list[bytes]:
    """bytes.lower() changes A-Z only."""
    return WORD.findall(text.lower()) if text else []


class PatternTables:
    """Shift tables and suffix buckets of one part of the benchmark, by pattern length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        patterns: dict[int, dict[tuple, set[str]]] = {}
        for item, text in items:
            w = words(text)
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                patterns.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).add(item)
        self.tables = []
        for n, found in sorted(patterns.items()):
            block = min(2, n)
            shift: dict[tuple, int] = {}
            buckets: dict[tuple, list[tuple[tuple, list[str]]]] = {}
            for pattern, ids in found.items():
                for end in range(block, n + 1):
                    key = pattern[end - block : end]
                    shift[key] = min(shift.get(key, n), n - end)
                buckets.setdefault(pattern[n - block :], []).append((pattern, sorted(ids)))
            self.tables.append((n, block, shift, buckets))

    def search(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of words inside occurrences, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for n, block, shift, buckets in self.tables:
            longest, end = n - block + 1, n
            while end <= len(w):
                key = tuple(w[end - block : end])
                step = shift.get(key, longest)
                if step:
                    end += step
                    continue
                here = tuple(w[end - n : end])
                for pattern, ids in buckets[key]:
                    if pattern == here:
                        spans.append((end - n, end))
                        items.update(ids)
                end += 1
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def benchmark_parts(benchmark: DataFrame, item_id: str, text: str, part_bytes: int) -> list[DataFrame]:
    """The benchmark's items in parts of about part_bytes each."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
        F.col(text).cast("string").cast("binary").alias("body"),
    )
    total = items.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "body"), F.lit(parts)))
    return [dealt.where(F.col("part") == k).select("item", "body") for k in range(parts)]


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """docs with n_words, n_hit, items (array of ids as strings) and contaminated.

    keep names the columns of docs to return. With more than one part, equal rows (in the kept columns and the text)
    are searched together and given back as often as they came; the kept columns must then be of types that can be
    grouped.
    """
    fields = [("n_words", "bigint"), ("__spans", "array<bigint>"), ("items", "array<string>")]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_hit", "items", "contaminated")]
    found = []
    parts = benchmark_parts(benchmark, item_id, item_text, part_bytes)
    source = docs.select(*kept, F.col(text).alias("__body"))
    if len(parts) > 1:
        source = source.withColumn("__print", F.sha2(F.coalesce("__body", F.lit("")), 256))
    for part in parts:
        rows = [(r["item"], bytes(r["body"]) if r["body"] is not None else None) for r in part.toLocalIterator()]
        shared = docs.sparkSession.sparkContext.broadcast(PatternTables(rows, window))

        def start(shared=shared):
            tables = shared.value

            def work(values: list) -> dict[str, list]:
                out: dict[str, list] = {"n_words": [], "__spans": [], "items": []}
                for body in values:
                    w = words(body)
                    spans, items = tables.search(w)
                    out["n_words"].append(len(w))
                    out["__spans"].append([(a << 32) + b for a, b in spans])
                    out["items"].append(sorted(items))
                return out

            return work

        columns = [c for c in source.columns if c != "__body"]
        found.append(annotate(source, start, fields, "__body", columns))
    hits = found[0]
    if len(found) > 1:
        for more in found[1:]:
            hits = hits.unionByName(more)
        hits = (
            hits.groupBy(*kept, "__print")
            .agg(
                F.first("n_words").alias("n_words"),
                F.flatten(F.collect_list("__spans")).alias("__spans"),
                F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
                (F.count(F.lit(1)) / len(found)).cast("int").alias("__times"),
            )
            .withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        )
    covered = F.expr(
        "aggregate(array_sort(__spans), named_struct('to', 0L, 'sum', 0L), (acc, x) -> named_struct("
        "'to', greatest(acc.to, x & 4294967295L),"
        "'sum', acc.sum + greatest(0L, (x & 4294967295L) - greatest(acc.to, shiftright(x, 32)))), acc -> acc.sum)"
    )
    return hits.withColumn("n_hit", covered).select(
        *kept, "n_words", "n_hit", F.array_sort("items").alias("items"), (F.col("n_hit") > 0).alias("contaminated")
    )
