"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Vocabulary: terms (runs of letters, lower-cased, and beginnings of longer ones) that tell the labels apart on the
training rows, by a chi-squared test; the cosine is exact over these terms, with inverse document frequencies from all
documents. Index: at most `examples` training rows of each label, the first by a hash of the row (the bound is a
parameter), sorted so that similar rows are neighbours and cut into blocks; for each term a block keeps its greatest
weight, and a block holds only the terms that its rows have. Search: a slice of texts at a time; the maxima bound each
block's best cosine with each text; every text opens its most promising block first, and then only blocks whose bound
reaches its k-th best cosine so far, so the k neighbours are exact. Vote: neighbours' labels weighted by
1 / (distance + 0.05); a text with no vocabulary term gets the share of label 1 among all training texts without one.
Calibration: votes of the index's own rows, each without itself, are grouped into steps and made monotone (pool
adjacent violators).

Cases: null and empty texts have no vocabulary terms. Null labels are never learnt from; a doc_id with two labels
counts for each. Equal cosines go to the earlier example. Repeated documents each get their row. Where no term tells
the labels apart (as with training rows of one label) every score is the share of label 1; without training rows it is
0. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, saved, texts

WORD = re.compile(r"[^\W\d_]+")
BLOCK = 64


#: A word longer than this many letters also gives the term of its beginning.
BEGINNINGS = (3, 4, 5, 6, 7)


def terms(word: str) -> list[str]:
    """A word's terms: itself, and its beginnings marked with ~ (so that inflected forms meet)."""
    return [word, *(word[:k] + "~" for k in BEGINNINGS if len(word) > k)]


def pieces(text: bytes | None) -> list[str]:
    """Lower-cased pieces between white space; no run of letters crosses one."""
    return text.decode("utf-8", "replace").lower().split() if text else []


class Memory(dict):
    """What made(piece) gives, remembered for a bounded number of pieces."""

    def __init__(self, made, limit: int = 300_000):
        super().__init__()
        self.made, self.limit = made, limit

    def __missing__(self, piece: str):
        if len(self) > self.limit:
            self.clear()
        found = self[piece] = self.made(piece)
        return found


class Vocabulary:
    """Numbers of the chosen terms."""

    def __init__(self, chosen: list[str]):
        self.number = {w: i for i, w in enumerate(chosen)}
        self.seen = Memory(self.numbers)

    def __len__(self) -> int:
        return len(self.number)

    def __reduce__(self):
        return Vocabulary, (list(self.number),)

    def numbers(self, piece: str) -> tuple[int, ...]:
        number = self.number
        return tuple(number[t] for w in WORD.findall(piece) for t in terms(w) if t in number)

    def count(self, text: bytes | None) -> dict[int, int]:
        """Occurrences of each term in a whole text."""
        out: dict[int, int] = {}
        for at in filter(None, map(self.seen.__getitem__, pieces(text))):
            for k in at:
                out[k] = out.get(k, 0) + 1
        return out


@dataclass
class Index:
    """Examples as unit vectors over the vocabulary, cut into blocks."""

    vocabulary: Vocabulary
    idf: np.ndarray
    ids: list
    labels: np.ndarray
    vectors: np.ndarray  # examples x terms, sorted
    base_rate: float
    k: int
    block: int = BLOCK  # rows in a block
    peaks: np.ndarray = field(init=False)  # terms x blocks: the greatest weight of a term in a block
    postings: list = field(init=False)  # for each block: its terms, and their weights (terms x rows)
    steps: tuple = (np.array([0.0]), np.array([0.0]))

    def __post_init__(self) -> None:
        blocks = [self.vectors[a : a + self.block] for a in range(0, len(self.vectors), self.block)]
        self.peaks = np.stack([b.max(0) for b in blocks], 1) if blocks else np.zeros((len(self.vocabulary), 0))
        self.postings = [(at := np.flatnonzero(b.any(0)), np.ascontiguousarray(b[:, at].T)) for b in blocks]

    def weighted(self, counts: list[dict[int, int]]) -> np.ndarray:
        """Unit TF-IDF vectors of texts; zeros where no term is in the vocabulary."""
        out = np.zeros((len(counts), max(len(self.vocabulary), 1)))
        row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        at = np.fromiter((w for c in counts for w in c), np.int64, len(row))
        n = np.fromiter((n for c in counts for n in c.values()), np.float64, len(row))
        out[row, at] = (1 + np.log(n)) * self.idf[at]
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(length > 0, length, 1)

    def nearest(self, queries: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query (unit vectors) the k examples of the greatest cosine over 0: cosines, and rows (-1: none).
        skip names a row for each query that isn't looked at. Exact."""
        n = len(queries)
        cosines, rows = np.zeros((n, self.k)), np.full((n, self.k), -1)
        if not self.postings:
            return cosines, rows
        bounds = queries @ self.peaks

        def look(b: int, who: np.ndarray) -> None:
            at, weights = self.postings[b]
            found = np.round(queries[np.ix_(who, at)] @ weights, 12)
            number = b * self.block + np.arange(weights.shape[1])
            if skip is not None:
                found[number[None, :] == skip[who][:, None]] = 0
            better = (found > 0) & (found >= cosines[who, -1:])
            some = better.any(1)
            who, found = who[some], np.where(better, found, 0)[some]
            c = np.concatenate([cosines[who], found], 1)
            r = np.concatenate([rows[who], np.where(found > 0, number[None, :], -1)], 1)
            best = np.lexsort((r, -c), axis=1)[:, : self.k]  # by cosine, ties by row
            cosines[who], rows[who] = np.take_along_axis(c, best, 1), np.take_along_axis(r, best, 1)

        first = bounds.argmax(1)
        live = bounds.max(1) > 0
        for b in np.unique(first[live]):
            look(b, np.flatnonzero(live & (first == b)))
        for b in np.argsort(-bounds.max(0), kind="stable"):
            open_ = (first != b) & (bounds[:, b] > 0) & (bounds[:, b] >= cosines[:, -1] - 1e-9)
            if open_.any():
                look(b, np.flatnonzero(open_))
        return cosines, rows

    def vote(self, cosines: np.ndarray, rows: np.ndarray) -> np.ndarray:
        w = np.where(rows >= 0, 1 / (1.05 - np.minimum(cosines, 1.0)), 0.0)
        total = w.sum(1)
        own = (w * self.labels[np.maximum(rows, 0)]).sum(1) if len(self.labels) else total
        return np.where(total > 0, own / np.where(total > 0, total, 1), self.base_rate)

    def calibrate(self, steps: int = 20) -> None:
        votes = []
        for a in range(0, len(self.vectors), 256):
            part = self.vectors[a : a + 256]
            votes.append(self.vote(*self.nearest(part, np.arange(a, a + len(part)))))
        if not votes:
            return
        v, t = np.concatenate(votes), self.labels.astype(float)
        order = np.argsort(v, kind="stable")
        pools: list[list[float]] = []  # [sum of labels, rows, sum of votes]
        for part in np.array_split(order, min(steps, len(order))):
            pools.append([t[part].sum(), len(part), v[part].sum()])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.steps = (np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.5 * self.base_rate) / (p[1] + 0.5) for p in pools]))

    def score(self, cosines: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.where(rows[:, 0] >= 0, np.interp(self.vote(cosines, rows), *self.steps), self.base_rate)


def _term_counts(labelled: DataFrame) -> DataFrame:
    """w, a (texts of label 1 with the term), n (texts with it): counted in each task first, a bounded number of
    terms at a time."""

    def run(batches):
        def fresh():
            names: dict[str, int] = {}
            number = lambda piece: tuple({names.setdefault(t, len(names)) for w in WORD.findall(piece) for t in terms(w)})
            return names, Memory(number), np.zeros((2, 1 << 16), np.int64)

        def told():
            a, n = (np.array(x[: len(names)]) for x in sums)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(a), pa.array(n)], names=["w", "a", "n"])

        names, seen, sums = fresh()
        for part, values in texts(batches):
            for label, body in zip(part.column(0).to_pylist(), values, strict=True):
                here = set().union(*map(seen.__getitem__, set(pieces(body))))
                at = np.fromiter(here, np.int64, len(here))
                while len(names) > sums.shape[1]:
                    sums = np.concatenate([sums, np.zeros_like(sums)], 1)
                sums[1, at] += 1
                sums[0, at] += label
            if len(names) > 300_000:
                yield told()
                names, seen, sums = fresh()
        if names:
            yield told()

    source = labelled.select("label", F.col("text").cast("string").cast("binary").alias("text"))
    counts = source.mapInArrow(run, "w string, a bigint, n bigint")
    return counts.groupBy("w").agg(F.sum("a").cast("double").alias("a"), F.sum("n").cast("double").alias("n"))


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """How many texts have each term, and how many texts there are: added up in each task, so that a task gives at
    most one row for each term."""

    def run(batches: Iterable[pa.RecordBatch]):
        found, number = np.zeros(len(vocabulary), np.int64), 0
        for _, values in texts(batches):
            number += len(values)
            for body in values:
                at = set().union(*filter(None, map(vocabulary.seen.__getitem__, set(pieces(body)))))
                found[np.fromiter(at, np.int64, len(at))] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *some], pa.int64()), pa.array([number, *found[some]], pa.int64())], names=["w", "n"])

    source = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    sums = source.mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()  # a row for each term
    out = np.zeros(len(vocabulary), np.int64)
    for r in sums:
        if r["w"] >= 0:
            out[r["w"]] = r["n"]
    return out, next((r["n"] for r in sums if r["w"] < 0), 0)


def choose_terms(labelled: DataFrame, most: int, least_docs: int, least_chi: float) -> list[str]:
    """Up to `most` terms whose presence goes with a label: chi-squared over least_chi, in least_docs texts or more."""
    sides = labelled.groupBy("label").count().collect()  # two rows
    n1 = sum(r["count"] for r in sides if r["label"] == 1)
    n0 = sum(r["count"] for r in sides if r["label"] == 0)
    if not n0 or not n1:
        return []
    per = _term_counts(labelled).where(F.col("n") >= least_docs)
    total = float(n0 + n1)
    expected = F.col("n") * (n1 / total)
    chi = F.pow(F.col("a") - expected, 2) / (expected * (n0 / total) * (1 - F.least(F.col("n") / total, F.lit(0.999999))))
    top = per.withColumn("chi", chi).where(F.col("chi") >= least_chi).orderBy(F.desc("chi"), "w").limit(most)
    return [r["w"] for r in top.collect()]


def train(
    docs: DataFrame,
    labels: DataFrame,
    chosen: Column,
    label: str = "toxic",
    text: str = "text",
    id_column: str = "doc_id",
    examples: int = 1500,
    labelled_rows: int = 200_000,
    words: int = 1000,
    least_docs: int = 5,
    least_chi: float = 25.0,
    k: int = 15,
    block: int = BLOCK,
) -> Index:
    """An index from the labelled rows where `chosen` (over docs) holds.

    labelled_rows: about that many labels are learnt from, chosen by a hash of the id, if there are more. examples: at
    most that many index rows of each label; words: at most that many terms. These bound what is broadcast, whatever
    the input; document frequencies are counted over all documents.
    """
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(id_column).alias("__id"), F.col(label).cast("int").alias("label"))
    number = marked.count()
    if number > labelled_rows:
        part = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * (labelled_rows / number))
        marked = marked.where(part)
    rows = docs.where(chosen).select(F.col(id_column).alias("__doc"), F.col(text).alias("text"))
    labelled = rows.join(F.broadcast(marked), F.col("__doc") == F.col("__id"))  # about labelled_rows pairs of numbers
    labelled = saved(labelled.select(F.col("__doc").alias("id"), "label", "text"), "toxicity-labelled")
    vocabulary = Vocabulary(choose_terms(labelled, words, least_docs, least_chi))
    found, total = document_frequencies(docs.select(F.col(text).alias("text")), vocabulary)
    idf = np.log((1 + total) / (1 + found)) + 1 if len(vocabulary) else np.ones(1)

    def start():
        def work(values: list) -> dict[str, list]:
            counts = [vocabulary.count(v) for v in values]
            return {"at": [list(c) for c in counts], "tf": [list(c.values()) for c in counts]}

        return work

    fields = [("at", "array<bigint>"), ("tf", "array<bigint>")]
    sparse = saved(annotate(labelled, start, fields, "text", ["id", "label"]), "toxicity-vectors")
    empty = sparse.where(F.size("at") == 0).agg(F.avg("label"), F.count(F.lit(1))).first()
    base = float(empty[0]) if empty[1] else 0.0
    picked = []
    for side in (0, 1):
        some = sparse.where((F.col("label") == side) & (F.size("at") > 0)).orderBy(F.xxhash64("id"), "id").limit(examples)
        picked += some.collect()
    if not len(vocabulary) or not picked:
        return Index(Vocabulary([]), idf, [], np.empty(0, int), np.zeros((0, 0)), base, k, block)
    vectors = np.zeros((len(picked), len(vocabulary)))
    for j, r in enumerate(picked):
        vectors[j, r["at"]] = (1 + np.log(r["tf"])) * idf[r["at"]]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    order = sorted(range(len(picked)), key=lambda j: (int(vectors[j].argmax()), -vectors[j].max(), picked[j]["id"]))
    index = Index(vocabulary, idf, [picked[j]["id"] for j in order], np.array([picked[j]["label"] for j in order]), vectors[order], base, k, block)
    index.calibrate()
    return index


def score(docs: DataFrame, index: Index, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """docs with score, predicted (score >= threshold) and the evidence: ids and cosines of the nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def start():
        index = shared.value

        def work(values: list) -> dict[str, list]:
            counts = [index.vocabulary.count(v) for v in values]
            known = np.array([k for k, c in enumerate(counts) if c], np.int64)
            scores = np.full(len(values), index.base_rate)
            evidence: list[list] = [[] for _ in values]
            cosines: list[list] = [[] for _ in values]
            if len(known) and index.ids:
                c, r = index.nearest(index.weighted([counts[k] for k in known]))
                scores[known] = index.score(c, r)
                for k, ck, rk in zip(known, c.tolist(), r.tolist(), strict=True):
                    evidence[k] = [index.ids[x] for x in rk if x >= 0]
                    cosines[k] = ck[: len(evidence[k])]
            return {"score": scores.tolist(), "evidence": evidence, "cosines": cosines}

        return work

    fields = [("score", "double"), ("evidence", "array<bigint>"), ("cosines", "array<double>")]
    kept = [c for c in (docs.columns if keep is None else keep) if c != "predicted"]
    scored = annotate(docs, start, fields, text, kept)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
