"""Substring deduplication with difference-cover anchors.

A window is `window` consecutive words. A word goes if a window that covers it has the same words as a window that
starts in a document with a smaller id; windows are judged on the input.

Windows at all positions are too many to compare, so anchors come first: runs of window - PERIOD + 1 words at the
positions whose remainder modulo PERIOD is in COVER. COVER is a difference cover: for any two positions some shift
below PERIOD takes both into it, so two equal windows always share an anchor that both documents name. Only windows
with an anchor that two documents have are hashed whole and compared, which extends the anchor to the full match.

Steps (blocks.py moves what they ask and answer): 1. Documents of equal words: all but the smallest id lose all their
words and take no further part. 2. Anchors that two documents have. 3. Of windows around such anchors, the smallest
id. 4. The words are removed.

Windows and whole documents are compared by 128-bit hashes, words within them by 64-bit ones. Anchors are compared by
fewer bits: a chance match there only costs work.

Cases: a null or empty text has no words. Ids are whole numbers; a null id counts as larger than all others. Rows
with equal ids never lose words to each other. Repeated rows all come back. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import WordHash, saved, window_hashes, window_hashes_at

PERIOD = 7
#: Every remainder modulo 7 is a difference of two of these.
COVER = (1, 2, 4)
NO_ID = np.int64(2**63 - 1)


class Block:
    """The texts of a block: words, hashes, ids, and which texts are the first of their words."""

    def __init__(self, payload: bytes, id_column: str, hashed: WordHash | None):
        self.rows = B.rows_of(payload)
        ids = self.rows.column(id_column).combine_chunks()
        self.ids = np.array([NO_ID if v is None else v for v in ids.to_pylist()], np.int64)
        self.words = [b.split() if b else [] for b in self.rows.column("__text").to_pylist()]
        self.hashed = hashed

    def prints(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of at least a window, and two hashes of all their words."""
        rows = np.array([k for k, w in enumerate(self.words) if len(w) >= window], np.int64)
        both = [xxhash.xxh3_128_intdigest(b" ".join(self.words[k])) for k in rows]
        return rows, np.array([p >> 64 for p in both], np.uint64), np.array([p & (2**64 - 1) for p in both], np.uint64)

    def firsts(self, window: int, answers: list[dict] | None) -> np.ndarray:
        """Rows that are no copy of a smaller id's words (one of several equal rows with the smallest id)."""
        rows, *prints = self.prints(window)
        _, _, at, least = smallest(*prints, self.ids[rows])
        smaller = B.joined(answers, np.uint8)
        return rows[(smaller[at] == 0) & (self.ids[rows] == least[at])]

    def concatenated(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of some rows one after another, and where each begins."""
        parts = [self.hashed(self.words[k]) for k in rows]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), starts


def smallest(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, check) pairs in order, each entry's place among them, and the smallest id of each."""
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(new)
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], starts) if len(starts) else np.empty(0, np.int64)
    return h[starts], c[starts], at, least


def anchors(hashes: np.ndarray, starts: np.ndarray, window: int, keep_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position in the concatenated words and number of the text of each anchor."""
    size = window - PERIOD + 1
    all_hashes = window_hashes(hashes, size, 1)
    at = np.arange(len(all_hashes))
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(at)]
    inside = at - starts[owner]
    good = np.isin(inside % PERIOD, COVER) & (at + size <= starts[owner + 1])
    low = np.uint64(64 - keep_bits)
    return (all_hashes[good] >> low) << low, at[good], owner[good]


def candidates(hashes: np.ndarray, starts: np.ndarray, window: int, shared_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows with an anchor at one of the positions shared_at: two hashes, position, number of the text."""
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    marked = np.zeros(len(hashes) + 1, np.int32)
    marked[shared_at + 1] = 1
    before = np.cumsum(marked)
    at = np.arange(len(hashes) - window + 1)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(at)]
    good = np.flatnonzero((before[at + PERIOD] > before[at]) & (at + window <= starts[owner + 1]))
    return window_hashes_at(hashes, good, window, 2), window_hashes_at(hashes, good, window, 3), good, owner[good]


def remove_repeats(
    docs: DataFrame,
    window: int = 13,
    text: str = "text",
    id_column: str = "doc_id",
    carry: list[str] | None = None,
    with_text: bool = False,
) -> DataFrame:
    """A row for each document: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), the
    columns in carry and, if asked for, kept_text."""
    if window < PERIOD:
        raise ValueError(f"windows need at least {PERIOD} words")
    extra = [c for c in carry or [] if c not in (id_column, "n_words", "n_removed", "kept_sha256", "kept_text")]
    source = docs.select(F.col(id_column).cast("bigint").alias(id_column), *extra, F.col(text).alias("__body"))
    packed = B.packed_blocks(source, "__body", [id_column, *extra], "repeat-blocks")
    shards = B.shards_for(packed)
    keep_bits = min(64, 32 + (shards - 1).bit_length())  # 32 bits within a shard: a chance match only costs work
    hashed = WordHash()

    def ask_copies(row: dict):
        b = Block(row["payload"], id_column, None)
        rows, *prints = b.prints(window)
        keys, checks, _, least = smallest(*prints, b.ids[rows])
        return keys, [least, checks]

    def smaller_elsewhere(hashes, values, owner):
        ids, checks = values
        _, _, at, least = smallest(hashes, checks, ids)
        return [(least[at] < ids).astype(np.uint8)], None

    copies = saved(B.answer(B.ask(packed, shards, ask_copies), smaller_elsewhere, [np.int64, np.uint64]), "repeat-copies")

    def anchors_of(row: dict):
        b = Block(row["payload"], id_column, hashed)
        firsts = b.firsts(window, row["copies"])
        words, starts = b.concatenated(firsts)
        return b, firsts, words, starts, anchors(words, starts, window, keep_bits)

    def ask_anchors(row: dict):
        *_, (found, _, owner) = anchors_of(row)
        keys, at = np.unique(found, return_inverse=True)
        first = np.full(len(keys), len(owner) + 1)
        last = np.full(len(keys), -1)
        np.minimum.at(first, at, owner)
        np.maximum.at(last, at, owner)
        return keys, [(last > first).astype(np.uint8)]

    def shared_by_two(hashes, values, owner):
        starts, run = B.runs(hashes)
        many = np.maximum.reduceat(values[0], starts) | (np.diff(starts, append=len(hashes)) > 1)
        return [many[run].astype(np.uint8)], None

    with_copies = B.with_answers(packed, copies, "copies")
    shared = saved(B.answer(B.ask(with_copies, shards, ask_anchors), shared_by_two, [np.uint8]), "repeat-anchors")

    def windows_of(row: dict):
        b, firsts, words, starts, (found, places, _) = anchors_of(row)
        _, at = np.unique(found, return_inverse=True)
        dup = B.joined(row["anchors"], np.uint8)[at] == 1 if len(found) else np.empty(0, bool)
        hashes, checks, where, owner = candidates(words, starts, window, places[dup])
        return b, firsts, starts, where, owner, smallest(hashes, checks, b.ids[firsts][owner])

    def ask_windows(row: dict):
        *_, (keys, checks, _, least) = windows_of(row)
        return keys, [least, checks]

    both = _answers_of(packed, copies=copies, anchors=shared)
    found = saved(B.answer(B.ask(both, shards, ask_windows), smaller_elsewhere, [np.int64, np.uint64]), "repeat-windows")
    every = _answers_of(packed, copies=copies, anchors=shared, windows=found)
    fields = [source.schema[c] for c in (id_column, *extra)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema = f"{kinds}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                b, firsts, starts, where, owner, (_, _, at, least) = windows_of(row)
                smaller = B.joined(row["windows"], np.uint8)
                gone = [np.zeros(len(w), bool) for w in b.words]
                for r, w in enumerate(b.words):
                    gone[r][:] = len(w) >= window  # copies, unless they are firsts
                covered = np.zeros(starts[-1] + 1, np.int32)
                if len(where):
                    dup = where[(smaller[at] == 1) | (b.ids[firsts][owner] > least[at])]
                    np.add.at(covered, dup, 1)
                    np.add.at(covered, dup + window, -1)
                covered = np.cumsum(covered) > 0
                for j, r in enumerate(firsts):
                    gone[r] = covered[starts[j] : starts[j + 1]]
                kept = [b" ".join([w for w, g in zip(ws, gs, strict=True) if not g]) for ws, gs in zip(b.words, gone, strict=True)]
                columns = [b.rows.column(f.name).combine_chunks() for f in fields]
                columns += [
                    pa.array([len(w) for w in b.words], pa.int64()),
                    pa.array([int(g.sum()) for g in gone], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                ]
                names = [f.name for f in fields] + ["n_words", "n_removed", "kept_sha256"]
                if with_text:
                    texts = b.rows.column("__text").to_pylist()
                    whole = [t if not g.any() else x for t, g, x in zip(texts, gone, kept, strict=True)]
                    columns.append(pa.array([t if t is None else t.decode("utf-8", "replace") for t in whole], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return every.mapInArrow(run, schema)


def _answers_of(packed: DataFrame, **answers: DataFrame) -> DataFrame:
    """packed with each step's answers; the answers meet first, so that the texts move once."""
    all_answers = None
    for name, a in answers.items():
        one = a.where("block >= 0").groupBy(F.col("block").alias("__b")).agg(
            F.sort_array(F.collect_list(F.struct("shard", "data"))).alias(name))
        all_answers = one if all_answers is None else all_answers.join(one, "__b", "full")
    return packed.join(all_answers, F.col("block") == F.col("__b"), "left").drop("__b")
