"""Packing token pieces into sequences: a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits a sequence. The program asks for the fewest configurations that cover
every length as often as it occurs. It is solved by multiplicative weights: lengths that are covered little have a high
weight, a knapsack dynamic program over the capacity prices configurations by weight for each occurrence, the best ones
through the heaviest lengths are taken in small steps, and the weights of what they cover fall. The solution is rounded
down, what is left is a smaller program that is solved again, and when rounding down leaves nothing the dearest
configuration of what is really left (a bounded knapsack) is taken whole, until every piece has its place.

The histogram has `capacity` entries at most, whatever the corpus, so the program is the driver's; documents never are.
Texts are encoded in Arrow tasks, and their pieces (without ids) written once. Pieces of a length are numbered in groups
of a bounded share of the length's pieces, each group sorted by itself, and the groups' starts are sums of counts. A
piece's number in its length says its sequence and place through a table of the rounded configurations, whose size
depends on the capacity alone.

Cases: a null text has only the end token. Repeated rows are pieces of their own; pieces of equal id, number and ids are
alike and may stand for each other. Null ids are carried. An empty table gives an empty result. A text of any length is
encoded in slices that end at white space, where the tokenizer never joins words; short texts share a slice. Columns named like those of the
result are replaced by them.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, pa_type, parts, saved

#: Bytes of texts whose words are numbered together, and of words that the library encodes at a time.
SLICE_BYTES, BATCH_BYTES = 4 << 20, 256 << 10
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words and cores that a generation of a worker's tables holds, and the longest word that it remembers.
WORDS_HELD, CORES_HELD, LONGEST_WORD = 500_000, 250_000, 64
#: A letter up to U+024F in UTF-8: composition leaves it alone, and lower case makes one letter of it (but of U+0130).
LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])"
LETTERS = re.compile(LETTER + rb"+")
#: What the tokenizer's rules make of a word: runs of letters, single digits, runs of marks.
UNITS = re.compile(LETTER + rb"+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class Remembered:
    """A table of two generations: when the young one is full it becomes the old one, whose entries that are asked for again
    come back. What is used often stays; what is held is bounded."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def missing(self, keys: set[bytes]) -> set[bytes]:
        """Those of the keys that aren't held; the others are in `now` after it."""
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now
        keys = keys.difference(self.now)  # plain dictionaries, which sets ask key by key
        if self.old:
            back = [k for k in keys if k in self.old]
            self.now.update(zip(back, map(self.old.__getitem__, back), strict=True))
            keys.difference_update(back)
        return keys


def batches(sizes: list[int], most: int) -> list[list[int]]:
    """Numbers of texts in batches: the largest text left opens one, and the next ones fill it up to `most` bytes."""
    out: list[list[int]] = []
    held = 0
    for k in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        if not out or held + sizes[k] > most:
            out.append([])
            held = 0
        out[-1].append(k)
        held += sizes[k] + 16
    return out


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts (binary), the number of each word of the texts among them, and where each text's words
    begin; one more at the end. A text that begins or ends with white space has an empty word there."""
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, b"").view(kind))
    found = lists.values.dictionary_encode()
    distinct = found.dictionary.view(texts.type).to_numpy(zero_copy_only=False).tolist()
    return distinct, found.indices.to_numpy(), lists.offsets.to_numpy()


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit numbers, for tokenizers that never join across white space.

    Arrow parts a slice of texts into words and numbers the distinct ones, so that Python meets each word once a slice.
    Words that were seen are looked up. New ones of Latin letters, ASCII digits and ASCII marks (no apostrophe) are parted
    into the units that the tokenizer's rules make of them: runs of letters, single digits, runs of marks. Letters are
    lower-cased, which is all that the rules do to them, and encoded together by the library's model under a tokenizer
    without those rules; each unit ends in a token that ends words, which is how the joined ids are parted again. All
    other units and words are encoded by the whole tokenizer, each by itself, in batches balanced by bytes.
    """

    def __init__(self, name: str, words_held: int | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = Tokenizer.from_file(public_tokenizers.path(name))
        made.no_truncation()
        made.no_padding()
        plain = Tokenizer(made.model)
        plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode = lambda t: [e.ids for e in made.encode_batch_fast(t, add_special_tokens=False)]
        self.letters = lambda t: plain.encode_batch_fast([t], add_special_tokens=False)[0].ids
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in made.get_added_tokens_decoder().values()) or b"$^")
        self.ends = np.zeros(made.get_vocab_size(), bool)
        for word, k in made.get_vocab().items():
            self.ends[k] = word.endswith("</w>")
        self.words, self.cores = Remembered(words_held or WORDS_HELD), Remembered(CORES_HELD)

    #: What is remembered of a unit's ids, and of a word's units.
    value = staticmethod(bytes)
    joined = staticmethod(b"".join)

    def parted(self, word: bytes) -> tuple[bytes, ...]:
        """The units of a word, letters in lower case; the word itself if the rules may do more to it."""
        if word.isalpha():  # ASCII
            return (word.lower(),)
        units = UNITS.findall(word)
        if len(units) == 1 and len(units[0]) == len(word):
            return (word.decode().lower().encode(),)
        if len(b"".join(units)) != len(word) or self.special.search(word):
            return (word,) if word else ()
        return tuple([u.lower() if u.isascii() else u.decode().lower().encode() for u in units])

    def learn(self, cores: list[bytes]) -> None:
        of, plain, rest = self.cores.now, [], []
        for c in cores:
            (plain if c.isalpha() or LETTERS.fullmatch(c) else rest).append(c)
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.letters(b" ".join(some).decode()), "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                rest += some
                continue
            data, ends = ids.tobytes(), (4 * ends).tolist()
            of.update(zip(some, [self.value(data[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        for batch in batches([len(c) for c in rest], BATCH_BYTES):
            for k, ids in zip(batch, self.encode([rest[k].decode("utf-8", "replace") for k in batch]), strict=True):
                of[rest[k]] = self.value(np.array(ids, "<u4").tobytes())

    def values(self, words: list[bytes]) -> list:
        """What is remembered of each of some distinct words, learnt where it is new."""
        new = {w: self.parted(w) for w in self.words.missing(set(words))}
        self.learn(sorted(self.cores.missing({u for units in new.values() for u in units})))
        of, cores = self.words.now, self.cores.now
        for w, units in new.items():
            of[w] = cores[units[0]] if len(units) == 1 else self.joined([cores[u] for u in units])
        found = list(map(of.__getitem__, words))
        for w, units in new.items():
            if len(w) > LONGEST_WORD:
                del of[w]
                for u in units:
                    cores.pop(u, None)
        return found

    @staticmethod
    def slices(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Texts of SLICE_BYTES together, and each one's row. A longer text is cut at white space into several of its row."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < len(texts):
            before = ends[row - 1] if row else 0
            stop = int(np.searchsorted(ends, before + SLICE_BYTES, "right"))
            if stop > row:
                yield texts.slice(row, stop - row), np.arange(row, stop)
                row = stop
                continue
            text, at = texts[row].as_py(), 0
            while at < len(text):
                found = SPACE.search(text, at + SLICE_BYTES)
                end = found.start() if found else len(text)
                yield pa.array([text[at:end]], texts.type), np.array([row])
                at = end
            row += 1

    def every(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (binary; null: empty), in order."""
        held, row = [], 0
        for some, rows in self.slices(texts):
            distinct, of, begin = words_of(some)
            parts = self.values(distinct)
            ids = np.frombuffer(b"".join(parts), "<u4")
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
            n = sizes[of]
            stop = np.append(0, np.cumsum(n))
            data = ids[np.repeat((np.cumsum(sizes) - sizes)[of] - stop[:-1], n) + np.arange(stop[-1])].tobytes()
            ends = (4 * stop[begin]).tolist()
            for r, a, b in zip(rows.tolist(), ends[:-1], ends[1:], strict=True):
                if r != row:
                    yield b"".join(held)
                    held, row = [], r
                held.append(data[a:b])
        if len(texts):
            yield b"".join(held)

    def __call__(self, text: bytes) -> bytes:
        return next(self.every(pa.array([text], pa.binary())))


class WordCounts(WordIds):
    """Token counts of texts by the same tables, which hold numbers instead of ids."""

    value = staticmethod(lambda data: len(data) >> 2)
    joined = staticmethod(sum)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text (binary; null: empty)."""
        out = np.zeros(len(texts), np.int64)
        for some, rows in self.slices(texts):
            distinct, of, begin = words_of(some)
            stop = np.append(0, np.cumsum(np.array(self.values(distinct), np.int64)[of]))
            np.add.at(out, rows, np.diff(stop[begin]))
        return out


#: One for each tokenizer in a Python worker, kept between its tasks.
_loaded: dict[str, WordIds] = {}


def token_pieces(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = 2048,
    end_id: int = 0,
    text: str = "text",
    keep: list[str] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """The kept columns (default: all but the text) with piece, start, length and ids_crc32, a row for each piece of each
    document; with_ids adds `ids`, the piece's tokens."""
    fields = [("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]
    fields += [("ids", "array<bigint>")] if with_ids else []
    own = {n for n, _ in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own and (keep is not None or c != text)]
    source = docs.select(*kept, F.col(text).cast("string").cast("binary").alias("__text"))
    schema = source.drop("__text").schema
    for f in docs.sparkSession.createDataFrame([], extended(fields)).schema:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, WordIds(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for part in parts(batches):
            row, made = [], {n: [] for n, _ in fields}
            for k, data in enumerate(ids_of.every(part.column(len(kept)))):
                data += end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    some = data[at : at + 4 * capacity]
                    row.append(k)
                    made["piece"].append(piece)
                    made["start"].append(at // 4)
                    made["length"].append(len(some) // 4)
                    made["ids_crc32"].append(zlib.crc32(some))
                    if with_ids:
                        made["ids"].append(np.frombuffer(some, "<u4").astype(np.int64))
            take = pa.array(row, pa.int64())
            columns = [part.column(i).take(take) for i in range(len(kept))]
            columns += [pa.array(made[n], pa_type(t)) for n, t in fields]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(n for n, _ in fields)])

    return source.mapInArrow(run, schema)


#: How much a length that is covered least is worth above its size, and the longest length above the shortest.
BEHIND, LONG = 0.3, 1.0


class Program:
    """The configuration program of a histogram of lengths: counts[l] pieces of length l, l up to the capacity."""

    def __init__(self, counts: np.ndarray, rounds: int = 60, step: float = 0.25, columns: int = 48):
        self.counts = np.asarray(counts, np.int64).copy()
        self.capacity = len(self.counts) - 1
        self.rounds, self.step, self.columns = rounds, step, columns
        self.rounded: list[tuple[dict[int, int], int]] = []

    def prices(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The knapsack by capacity: best[c], the greatest value of lengths of sum c at most, any number of each; took[c],
        the length that it takes last (0: best[c - 1] stands)."""
        best, took = np.zeros(self.capacity + 1), np.zeros(self.capacity + 1, np.int64)
        for c in range(1, self.capacity + 1):
            through = value[1 : c + 1] + best[c - 1 :: -1]
            l = int(through.argmax())
            if through[l] > best[c - 1]:
                best[c], took[c] = through[l], l + 1
            else:
                best[c] = best[c - 1]
        return best, took

    def through(self, length: int, took: np.ndarray, left: np.ndarray) -> dict[int, int]:
        """A best configuration that has the length, no length more often than it is left."""
        found, c = {length: 1}, self.capacity - length
        while c > 0:
            l = int(took[c])
            if not l:
                c -= 1
            elif found.get(l, 0) < left[l]:
                found[l] = found.get(l, 0) + 1
                c -= l
            else:
                c -= 1
        return found

    def bounded(self, value: np.ndarray, left: np.ndarray, room: int) -> dict[int, int]:
        """The best configuration of what is left within a room: each length by powers of two of its count."""
        lengths = np.flatnonzero(left[: room + 1])
        best = np.zeros(room + 1)
        chose: list[tuple[int, int, np.ndarray]] = []
        for l in lengths.tolist():
            rest, k = min(int(left[l]), room // l), 1
            while rest > 0:
                k = min(k, rest)
                w = k * l
                other = best[: room + 1 - w] + k * value[l]
                better = other > best[w:]
                best[w:] = np.where(better, other, best[w:])
                chose.append((l, k, better))
                rest -= k
                k *= 2
        found, c = {}, room
        for l, k, better in reversed(chose):
            w = k * l
            if c >= w and better[c - w]:
                found[l] = found.get(l, 0) + k
                c -= w
        return found

    def weights(self, left: np.ndarray) -> dict[tuple, float]:
        """Multiplicative weights for what is left: configurations and how many sequences should have each."""
        lengths = np.flatnonzero(left)
        cover = np.zeros(self.capacity + 1)
        used: dict[tuple, float] = {}
        value = np.zeros(self.capacity + 1)
        rate = np.log(len(lengths) + 1)
        worth = lengths / self.capacity
        for _ in range(self.rounds):
            behind = np.exp(-rate * (cover[lengths] - cover[lengths].min()))
            value[:] = 0
            value[lengths] = worth * (1 + BEHIND * behind + LONG * worth)
            best, took = self.prices(value)
            heavy = lengths[np.argsort(-behind, kind="stable")[: self.columns]]
            for l in heavy.tolist():
                found = self.through(l, took, left)
                number = self.step * min(left[k] / n for k, n in found.items())
                for k, n in found.items():
                    cover[k] += number * n / left[k]
                key = tuple(sorted(found.items()))
                used[key] = used.get(key, 0.0) + number
        scale = max(float(np.median(cover[lengths])), 1e-9)
        return {k: x / scale for k, x in used.items()}

    def take(self, found: dict[int, int], number: int, left: np.ndarray) -> None:
        self.rounded.append((found, number))
        for l, n in found.items():
            left[l] -= n * number

    def solve(self) -> list[tuple[dict[int, int], int]]:
        """Configurations (length -> how often) and how many sequences have each; every piece has its place."""
        left = self.counts.copy()
        left[0] = 0
        if left[self.capacity]:
            self.take({self.capacity: 1}, int(left[self.capacity]), left)
        while left.any():
            used = self.weights(left)
            taken = 0
            size = {key: sum(l * n for l, n in key) for key in used}
            order = sorted(used.items(), key=lambda x: (-size[x[0]], -x[1], x[0]))
            half = np.searchsorted(np.cumsum([x for _, x in order]), sum(used.values()) / 2)
            for key, number in order:
                if size[key] < size[order[half][0]]:  # less full than most: the next program may fill it better
                    break
                found = dict(key)
                number = min(int(number), *(int(left[l]) // n for l, n in key))
                if number > 0:
                    self.take(found, number, left)
                    taken += number
            if taken * self.capacity * 4 < left @ np.arange(self.capacity + 1):
                break
        self.finish(left)
        return self.rounded

    def finish(self, left: np.ndarray) -> None:
        """What rounding down has left, the longest lengths first: configurations that fill a sequence wholly, many from one
        table of prices, and where there is none the fullest one of what is really left. Of equally full ones the one with
        the longest lengths is the dearest, so that short lengths stay for later gaps."""
        every = np.arange(self.capacity + 1)
        while left.any():
            lengths = np.flatnonzero(left)
            value = np.where(left > 0, every * (1 + LONG * every / self.capacity), 0.0)
            took = self.prices(value)[1]
            full = 0
            for l in lengths[::-1].tolist():
                if not left[l]:
                    continue
                found = self.through(l, took, left)
                if sum(k * n for k, n in found.items()) == self.capacity:
                    self.take(found, max(1, min(int(left[k]) // n for k, n in found.items()) // 2), left)
                    full += 1
            if not full:
                longest = int(lengths[-1])
                left[longest] -= 1
                found = self.bounded(value, left, self.capacity - longest)
                left[longest] += 1
                found[longest] = found.get(longest, 0) + 1
                self.take(found, min(int(left[k]) // n for k, n in found.items()), left)


#: Groups in which the pieces of one length are numbered, and pieces that one of them has at least.
MOST_GROUPS, GROUP_ROWS = 4096, 256


def places(rounded: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Of the rounded configurations: for runs of a length's numbers (length, first number), in order, the sequence of the
    first one and the place; each next number of the run is in the next sequence."""
    given: dict[int, int] = {}
    runs, sequence = [], 0
    for found, number in rounded:
        offset = 0
        for l, n in sorted(found.items(), reverse=True):
            for _ in range(n):
                runs.append((l, given.get(l, 0), sequence, offset))
                given[l] = given.get(l, 0) + number
                offset += l
        sequence += number
    runs.sort()
    return tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else (np.empty(0, np.int64),) * 4


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """The pieces (rows with a length, and whatever else) with sequence_id and offset. They are written out with a number of
    their own first, which spreads equal rows over groups and stays as it is when a task runs again."""
    spark = pieces.sparkSession
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = saved(pieces.select(*own, F.monotonically_increasing_id().alias("__own")), "pieces")
    found = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["count"]
    runs = places(Program(counts).solve())
    groups = spark.createDataFrame(
        [(r["length"], min(MOST_GROUPS, -(-r["count"] // GROUP_ROWS))) for r in found], "length bigint, __groups bigint"
    )
    group = F.pmod(F.xxhash64("__own"), F.col("__groups")).alias("__group")
    salted = pieces.join(F.broadcast(groups), "length").select(*own, "__own", group)
    sizes = salted.groupBy("length", "__group").count()
    starts = sizes.select(
        "length", "__group",
        (F.sum("count").over(Window.partitionBy("length").orderBy("__group")) - F.col("count")).alias("__start"),
    )
    within = Window.partitionBy("length", "__group").orderBy("__own")
    numbered = salted.withColumn("__row", F.row_number().over(within)).join(starts, ["length", "__group"])
    numbered = numbered.select(*own, (F.col("__start") + F.col("__row") - 1).alias("__number"))
    table = spark.sparkContext.broadcast(runs)  # its size depends on the capacity alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = table.value
        step = np.int64(1) << np.int64(48)
        keys = length * step + first
        for batch in batches:
            l = np.asarray(batch.column(own.index("length")), np.int64)
            n = np.asarray(batch.column(len(own)), np.int64)
            at = np.searchsorted(keys, l * step + n, "right") - 1
            columns = [batch.column(i) for i in range(len(own))]
            columns += [pa.array(sequence[at] + n - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "sequence_id", "offset"])

    schema = numbered.drop("__number").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Documents to packed pieces; each document is encoded once."""
    return pack(token_pieces(docs, tokenizer, capacity, keep=keep, with_ids=with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and lengths of what pack_documents(with_ids=True) returns: the pieces one after the other."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # a sequence has `capacity` tokens at most
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths")
    )
