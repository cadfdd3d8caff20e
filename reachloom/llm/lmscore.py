"""Language-model scores by a probabilistic suffix tree over words.

Symbols are words (A-Z lower-cased) and one end after each text. Contexts are the runs of up to `order` symbols before a
symbol. A context is a candidate if it occurs at least `least` times, whatever the corpus's size, and it stays in the
tree only if what follows it differs from what its longest suffix in the tree predicts: the divergence of the two
next-symbol distributions, times the context's count, has to be over `least_divergence`. Candidates grow longer whether
or not they stay; one that doesn't stay hands its suffix's distribution on. Next symbols kept at a node are those seen
there at least `least` times. A node's distribution is smoothed with its suffix's by absolute discounting, down to the
word counts of the whole corpus:

    P(x | s) = max(c(s x) - discount, 0) / c(s) + rest(s) * P(x | longest suffix of s in the tree)

A text starts in the context of an end. Each symbol is scored in the longest contexts before it that the tree holds.

The tree grows with the corpus, so it is never whole in one place. Texts become blocks of word numbers (blocks.py). One
exchange with shards of the word hashes counts the words, and one exchange for each length d counts what follows the
contexts of d symbols: a block sends each of its contexts with the distinct symbols that follow it there, the shard that
a context's hash names sees all of them, decides whether the context stays, and answers with the counts and the rest.
A context that is more frequent than `hot` is split by the symbols that follow it, and its sums are added up from the
parts; as all contexts of one length share the corpus's occurrences, there are at most corpus / hot of them, 200,000.

Cases: a null text is empty: one end. Null ids are learnt from unless `held` says otherwise. Repeated rows count and
come back as often as they occur. Without training rows the counts are 0. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import extended, mixed

#: The end symbol: a word that no text can have, as this byte isn't UTF-8.
END = b"\xff"
#: Raw text bytes for one shard.
SHARD_BYTES = 8 << 20
#: Occurrences from which a context is split, at least; and the most contexts of one length that may be split.
HOT, MOST_HOT = 1 << 20, 200_000


def symbols_of(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Texts (binary) as symbols: lengths of the texts, each symbol's number, and what the numbers stand for."""
    text = pc.replace_substring(pc.fill_null(text, b""), END, b"\xef\xbf\xbd").cast(pa.string(), safe=False)
    text = pc.ascii_trim_whitespace(pc.ascii_lower(text))
    split = pc.ascii_split_whitespace(text)  # an empty text is one empty word here
    full = pc.binary_length(text).to_numpy() > 0
    lengths = np.where(full, pc.list_value_length(split).to_numpy(), 0).astype(np.int64) + 1
    words = pc.list_flatten(split)
    if not full.all():
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    words = words.dictionary_encode().combine_chunks()
    known = [*words.dictionary.cast(pa.binary()).to_pylist(), END]
    ends = np.zeros(lengths.sum(), bool)
    ends[np.cumsum(lengths) - 1] = True
    numbers = np.full(len(ends), len(known) - 1, np.int64)
    numbers[~ends] = words.indices.to_numpy()
    return lengths, numbers, known


def symbol_blocks(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Blocks of symbols instead of texts: lengths (symbols of each text), words (sorted hashes of the block's distinct
    symbols), codes (each symbol's place among them)."""

    def start():
        def work(rows: pa.Table):
            lengths, numbers, local = symbols_of(rows.column("__text"))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, local), np.uint64, len(local))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            return rows.drop_columns(["__text"]), [B.put(lengths), B.put_sorted(hashes[order]), B.put(place[numbers])]

        return work

    return B.packed_blocks(docs, "__body", columns, "lm-symbols", start, ("lengths", "words", "codes"), buckets)


@dataclass
class Totals:
    """What the word exchange tells of the corpus, and the model's parameters."""

    total: int
    distinct: int
    shards: int
    least: int
    discount: float
    least_divergence: float
    hot: int

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))


def coded(contexts: np.ndarray, symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, symbol) pairs in order: contexts, symbols; and each position's pair."""
    low = np.uint64(max(0, width - 1).bit_length())
    key = contexts.astype(np.uint64)
    key <<= low
    key |= symbols.astype(np.uint64, copy=False) if symbols.dtype.kind == "u" else symbols.view(np.uint64)
    bits = max(1, (len(key) - 1).bit_length())
    if len(key) and int(key.max()).bit_length() + bits <= 64:  # sorts key and position as one number
        key <<= np.uint64(bits)
        key |= np.arange(len(key), dtype=np.uint64)
        key.sort()
        at = (key & np.uint64((1 << bits) - 1)).view(np.int64)
        key >>= np.uint64(bits)
    else:
        at = np.argsort(key)
        key = key[at]
    starts, run = B.runs(key)
    inverse = np.empty(len(key), np.int64)
    inverse[at] = run
    found = key[starts]
    return (found >> low).view(np.int64), (found & np.uint64((1 << int(low)) - 1)).view(np.int64), inverse


def joined_runs(contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Hashes of contexts followed by a symbol."""
    return mixed(mixed(contexts) ^ symbols)


@dataclass
class Level:
    """The contexts of one length in a block, the positions that follow them, and the distinct pairs of both."""

    contexts: np.ndarray  # sorted hashes
    counts: np.ndarray  # of the contexts, in the whole corpus
    at: np.ndarray  # positions
    of: np.ndarray  # each position's context
    pair_context: np.ndarray
    pair_symbol: np.ndarray
    asked: np.ndarray  # the places in at of positions with a pair: elsewhere the suffix's is too rare for one to be kept
    pair: np.ndarray  # their pairs


class Walk:
    """A block's symbols, taken through the answers of the exchanges so far."""

    def __init__(self, row: dict, known: Totals, hot: list[tuple[np.ndarray, np.ndarray]]):
        self.known = known
        self.lengths = B.get(row["lengths"], np.int64)
        self.words, codes = B.get_sorted(row["words"]), B.get(row["codes"], np.uint32).astype(np.int64)
        self.codes, self.rows = codes, B.rows_of(row["payload"])
        self.learnt = np.repeat(~np.array(self.rows.column("held_out").to_pylist(), bool), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        self.first = np.zeros(len(codes) + 1, bool)  # of a text; and what lies behind the last
        self.first[starts], self.first[-1] = True, True
        counts = B.joined(row["words_answer"], np.int64, "counts")
        self.counts, self.told = counts, row["words_answer"]
        self.p = known.base(counts)[codes]
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[starts] = np.searchsorted(self.words, xxhash.xxh3_64_intdigest(END))
        often = counts >= known.least
        self.frequent = often[codes]  # the pair with the suffix occurs often enough
        deep = np.flatnonzero(often[before])
        self.level = self._level(self.words, counts, deep, before[deep])
        for d in range(1, row["depths"] + 1):
            self._step(row[f"depth_{d}"], hot[d - 1], row["depths"] == d and row["last"])

    def _level(self, contexts, counts, at, of) -> Level:
        asked = np.flatnonzero(self.frequent[at])
        pair_context, pair_symbol, pair = coded(of[asked], self.codes[at[asked]], len(self.words))
        return Level(contexts, counts, at, of, pair_context, pair_symbol, asked, pair)

    def pieces(self) -> tuple[np.ndarray | slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pairs in the order in which they are asked, and the pieces that they are asked in: how many pairs each
        has, its hash, its context, and whether it is a part of a split context. A context without pairs is asked for
        its rest alone. Contexts are in the order of their hashes, so that only parts of split ones have to be sorted in."""
        x = self.level
        split = x.counts > self.known.hot
        met = np.zeros(len(x.contexts), bool)
        met[x.of] = True
        context = np.flatnonzero(met & ~split)
        sizes = np.bincount(x.pair_context, minlength=len(x.contexts))
        size, route = sizes[context], x.contexts[context]
        cut = np.flatnonzero(split[x.pair_context]) if split.any() else []
        if not len(cut):
            return slice(None), size, route, context, np.zeros(len(context), bool)
        of, high = x.pair_context[cut], (self.words[x.pair_symbol[cut]] >> np.uint64(32)).astype(np.int64)
        part = (high * -(-x.counts[of] // self.known.hot)) >> 32  # symbols are in the order of their hashes: parts are runs
        new = np.ones(len(cut), bool)
        new[1:] = (of[1:] != of[:-1]) | (part[1:] != part[:-1])
        new = np.flatnonzero(new)
        begin = np.concatenate([(np.cumsum(sizes) - sizes)[context], cut[new]])
        size = np.concatenate([size, np.diff(new, append=len(cut))])
        route = np.concatenate([route, mixed(x.contexts[of[new]] + np.uint64(1) + part[new].astype(np.uint64))])
        partial = np.arange(len(route)) >= len(context)
        context = np.concatenate([context, of[new]])
        order = np.argsort(route, kind="stable")  # the first are in order
        begin, size = begin[order], size[order]
        pairs = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(x.pair_context))
        return pairs, size, route[order], context[order], partial[order]

    def ask(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
        x = self.level
        pairs, size, route, context, partial = self.pieces()
        at = x.at[x.asked]
        n = np.bincount(x.pair[self.learnt[at]], minlength=len(x.pair_context)).astype(np.uint32)
        some = np.empty(len(x.pair_context), np.int64)  # a position of each pair
        some[x.pair] = at
        p = np.log10(self.p[some]).astype(np.float16)
        origin = np.where(partial, x.contexts[context], np.uint64(0))
        numbers = np.concatenate([B.get(a["numbers"], np.int64) * self.known.shards + a["shard"] for a in self.told])
        return route, [x.counts[context], origin], size, [numbers[x.pair_symbol[pairs]], n[pairs], p[pairs]]

    def _step(self, answers: list[dict] | None, hot: tuple[np.ndarray, np.ndarray], last: bool) -> None:
        x, known = self.level, self.known
        pairs, _, _, context, _ = self.pieces()
        (told, rests), _ = B.unbundled([a["data"] for a in answers or []], ANSWERED)
        counts = np.empty(len(x.pair_context), np.int64)
        counts[pairs] = told
        rest = np.full(len(x.contexts), -1.0)  # negative: the context doesn't stay
        rest[context] = rests
        split = np.flatnonzero(x.counts > known.hot)  # also those that this block asked nothing of
        if len(split) and len(hot[0]):
            place = np.minimum(np.searchsorted(hot[0], x.contexts[split]), len(hot[0]) - 1)
            rest[split] = np.where(hot[0][place] == x.contexts[split], hot[1][place], -1.0)
        kept = counts >= known.least
        left = rest[x.of]
        stays = left >= 0
        left[~stays] = 1
        self.p[x.at] *= left
        there = np.flatnonzero(kept[x.pair])
        pair, asked = x.pair[there], x.asked[there]
        at, added = x.at[asked], np.flatnonzero(stays[asked])
        own = (counts - known.discount) / x.counts[x.pair_context]
        self.p[at[added]] += own[pair[added]]
        if last:
            return
        self.frequent = np.zeros(len(self.codes), bool)
        self.frequent[at] = True
        at = at + 1
        on = np.flatnonzero(~self.first[at])
        pair, at = pair[on], at[on]
        named = np.zeros(len(kept), bool)
        named[pair] = True
        named = np.flatnonzero(named)
        runs = joined_runs(x.contexts[x.pair_context[named]], self.words[x.pair_symbol[named]])
        order = np.argsort(runs)
        place = np.zeros(len(kept), np.int64)
        place[named[order]] = np.arange(len(order))
        self.level = self._level(runs[order], counts[named[order]], at, place[pair])


#: What a block sends to a shard: steps between its pieces' hashes, their counts, origins and sizes; then of each piece's
#: entries the symbol, the count in the block and the suffix's probability. What comes back: counts of the entries, and
#: rests of the pieces.
ASKED = (np.uint64, np.int64, np.uint64, np.uint32, np.int64, np.uint32, np.float16)
ANSWERED = (np.int64, np.float32)


def _ask(blocks: DataFrame, shards: int, question) -> DataFrame:
    """shard, block, data (ASKED)."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                pieces, values, sizes, entries = question(row)
                full, at = B.shard_runs(pieces, shards)
                deep = np.concatenate([[0], np.cumsum(sizes)])[at]
                steps = np.diff(pieces, prepend=np.uint64(0))
                steps[at[:-1]] = pieces[at[:-1]]
                sent = [steps, *values, sizes.astype(np.uint32), *entries]
                data = B.bundles(sent, [at] * (2 + len(values)) + [deep] * len(entries))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array([row["block"]] * len(full), pa.int64()), pa.array(data, pa.binary())],
                    names=["shard", "block", "data"],
                )
            pa.default_memory_pool().release_unused()

    return blocks.mapInArrow(run, "shard int, block bigint, data binary")


def _answer(asked: DataFrame, known: Totals) -> DataFrame:
    """shard, block, data (ANSWERED; a rest under 0: the context doesn't stay). A row with block -1 - shard has the
    shard's number of kept next symbols and the sums of its parts of split contexts."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids = table.column("block").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        sent = table.column("data")
        (steps, cc, origin, sizes, symbol, n, p), lengths = B.unbundled([sent[k].as_py() for k in order], ASKED)
        cuts = np.concatenate([[0], np.cumsum(lengths[:, 0])])
        sizes = sizes.astype(np.int64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(steps, dtype=np.uint64)])
        hashes = sums[1:] - np.repeat(sums[cuts[:-1]], lengths[:, 0])  # sums of each message's own steps
        by = np.argsort(hashes)
        starts, run = B.runs(hashes[by])
        found, first, of = hashes[by][starts], by[starts], np.empty(len(by), np.int64)  # the contexts, and each piece's
        of[by] = run
        _, _, pair = coded(np.repeat(of, sizes), symbol, int(symbol.max(initial=0)) + 1)
        some = np.empty(pair.max(initial=-1) + 1, np.int64)  # an entry of each pair
        some[pair] = np.arange(len(pair))
        owner = np.repeat(of, sizes)[some]
        totals = np.bincount(pair, n, len(some)).astype(np.int64)
        count, origin = cc[first].astype(np.float64), origin[first]
        kept = totals >= known.least
        own = np.where(kept, totals - known.discount, 0) / np.maximum(count[owner], 1)
        under = np.where(kept, np.power(10.0, p[some].astype(np.float64)), 0.0)
        add = lambda v: np.bincount(owner, v, len(found))
        gain = own * np.log(np.where(kept, own, 1) / np.where(kept, under, 1))
        sums = np.stack([count, add(kept), add(own), add(gain), add(under)], 1)
        rest = _decided(sums, known.least_divergence)
        split = origin > 0
        head = np.concatenate([[np.float64(kept.sum())], np.column_stack([origin[split].view(np.float64), sums[split]]).ravel()])
        totals[~kept] = 0
        counts, rests = totals[pair], rest.astype(np.float32)[of]
        deep = np.concatenate([[0], np.cumsum(sizes)])[cuts]
        data = B.bundles([counts, rests], [deep, cuts])
        out = [(-1 - shard, head.tobytes()), *((ids[k], d) for k, d in zip(order, data, strict=True))]
        return pa.table(
            {
                "shard": pa.array([shard] * len(out), pa.int32()),
                "block": pa.array([x[0] for x in out], pa.int64()),
                "data": pa.array([x[1] for x in out], pa.binary()),
            }
        )

    return asked.groupBy("shard").applyInArrow(run, "shard int, block bigint, data binary")


def _decided(sums: np.ndarray, least: float) -> np.ndarray:
    """Each context's rest, or -1 if it doesn't stay. sums: its count, kept next symbols, what they take of one, their
    part of the divergence, and what the suffix gives them; all other symbols count as one."""
    count, kinds, own, gain, under = sums.T
    rest = 1 - own
    left, theirs = np.clip(rest, 1e-9, 1), np.clip(1 - under, 1e-9, 1)
    stays = (kinds > 0) & (count * (gain + left * np.log(left / theirs)) > least)
    return np.where(stays, rest, -1.0)


def _hot(answers: DataFrame, least: float) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """How many next symbols were kept, and the rests of split contexts by hash: at most MOST_HOT."""
    kept, rows = 0, [np.empty((0, 6))]
    for r in answers.where("block < 0").select(F.col("depth")[0]["data"]).toLocalIterator():
        head = np.frombuffer(r[0], np.float64)
        kept += int(head[0])
        rows.append(head[1:].reshape(-1, 6))
    rows = np.concatenate(rows)
    names, first, at = np.unique(np.ascontiguousarray(rows[:, 0]).view(np.uint64), return_index=True, return_inverse=True)
    sums = np.stack([rows[first, 1], *(np.bincount(at, rows[:, j], len(names)) for j in range(2, 6))], 1)
    return kept, (names, _decided(sums, least))


def _words(asked: DataFrame) -> DataFrame:
    """shard, block, counts, numbers (the words' places in the shard); block -1 - shard: distinct and all words."""

    def reply(hashes, values, owner):
        starts, run = B.runs(hashes)
        totals = np.add.reduceat(values[0].astype(np.int64), starts)
        return [totals[run], run], np.array([(totals > 0).sum(), totals.sum()], np.int64).tobytes()

    return B.answer(asked, reply, [np.uint32], ("counts", "numbers"))


def train_and_score(
    docs: DataFrame,
    held: Column,
    text: str = "text",
    id_column: str = "doc_id",
    order: int = 4,
    least: int = 2,
    least_divergence: float = 10.0,
    discount: float = 0.5,
    hot: int | None = None,
) -> DataFrame:
    """A row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    held marks the documents that are only scored. order: the longest context.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column), F.col(text).alias("__body"), F.coalesce(held, F.lit(False)).alias("held_out"))
    buckets = B.buckets_for(source, "__body")
    blocks = symbol_blocks(source, [id_column, "held_out"], buckets)
    shards = B.shards_for(blocks, SHARD_BYTES)

    def all_words(row: dict):
        learnt = np.repeat(~np.array(B.rows_of(row["payload"]).column("held_out").to_pylist(), bool), B.get(row["lengths"], np.int64))
        keys = B.get_sorted(row["words"])
        return keys, [np.bincount(B.get(row["codes"], np.uint32), learnt, len(keys)).astype(np.uint32)]

    def told(answers: DataFrame, name: str) -> None:
        nonlocal blocks
        blocks = blocks.join(answers.select("block", F.col(answers.columns[1]).alias(name)), "block", "left")

    words = B.bucketed_answers(_words(B.ask(blocks, shards, all_words)), "words_answer", ("counts", "numbers"), buckets)
    found = [np.frombuffer(r[0], np.int64) for r in words.where("block < 0").select(F.col("words_answer")[0]["counts"]).toLocalIterator()]
    distinct, total = map(int, np.sum(found, axis=0)) if found else (0, 0)
    told(words, "words_answer")
    known = Totals(total, distinct, shards, least, discount, least_divergence, hot or max(HOT, -(-total // MOST_HOT)))
    split: list[tuple[np.ndarray, np.ndarray]] = []

    def walk(row: dict, depths: int, last: bool, split) -> Walk:
        return Walk(row | {"depths": depths, "last": last}, known, split)

    depths = 0
    while depths < order:
        asked = _ask(blocks, shards, lambda row, d=depths, s=tuple(split): walk(row, d, False, s).ask())
        answers = B.bucketed_answers(_answer(asked, known), "depth", ("data",), buckets)
        kept, more = _hot(answers, least_divergence)
        depths += 1
        split.append(more)
        told(answers, f"depth_{depths}")
        if not kept:  # no longer contexts
            break
    fields = [(id_column, kind), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"),
              ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    every = tuple(split)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                w = walk({n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}, depths, True, every)
                text_of = np.repeat(np.arange(len(w.lengths)), w.lengths)
                add = lambda x: np.bincount(text_of, x, len(w.lengths))
                yield pa.RecordBatch.from_arrays(
                    [
                        w.rows.column(id_column).combine_chunks(),
                        w.rows.column("held_out").combine_chunks(),
                        pa.array(w.lengths, pa.int64()),
                        pa.array(add((w.counts > 0)[w.codes]).astype(np.int64)),
                        pa.array(np.full(len(w.lengths), total), pa.int64()),
                        pa.array(add(np.log10(known.base(w.counts))[w.codes])),
                        pa.array(add(np.log10(w.p))),
                    ],
                    names=[n for n, _ in fields],
                )

    return blocks.mapInArrow(run, extended(fields))
