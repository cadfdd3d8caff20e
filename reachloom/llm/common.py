"""Helpers that the text operators share: scratch tables, column names, word patterns, packed blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved  # noqa: F401  (the operators take it from here)

#: What parts words in Java's regular expressions: ASCII white space. bytes.split() parts UTF-8 text alike.
SPACE_SPLIT = r"[\x20\x09-\x0D]+"
#: Raw text bytes that one packed block holds.
BLOCK_BYTES = 4 << 20
#: Rows of a batch that are turned into Python objects at a time.
SLICE_ROWS = 256
#: Rows of a batch whose columns are worked on at a time.
COLUMN_ROWS = 4096


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


def texts(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of record batches with one column as Python values, so that few long texts are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield part, part.column(part.schema.get_field_index(column)).to_pylist()


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of record batches for work on whole columns: more rows than texts() takes, few enough for what they become."""
    for batch in batches:
        for at in range(0, batch.num_rows, COLUMN_ROWS):
            yield batch.slice(at, COLUMN_ROWS)


def extended(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in fields)


class WordHash:
    """64-bit hashes of words, remembered for a bounded number of distinct words."""

    def __init__(self, limit: int = 200_000):
        self.seen: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.limit:
            seen.clear()
        new = set(words).difference(seen)
        for w in new:
            seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x + MIX
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes, by position of the first word."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - n + 1, np.uint64((0x51ED270B + seed * 0x632BE59BD9B4E019) % 2**64), np.uint64)
    for i in range(n):
        out = mixed(out ^ h[i : len(h) - n + 1 + i])
    return out


def window_hashes_at(h: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the runs of n consecutive word hashes that begin at some positions."""
    out = np.full(len(at), np.uint64((0x51ED270B + seed * 0x632BE59BD9B4E019) % 2**64), np.uint64)
    for i in range(n):
        out = mixed(out ^ h[at + i])
    return out


#: One of each for a process: a task's messages are many and small, and setting these up costs more than packing one.
_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(data: bytes) -> bytes:
    return _PACKER.compress(data)


def unpack(data: bytes) -> bytes:
    return _UNPACKER.decompress(data)


def annotate(
    df: DataFrame,
    start: Callable[[], Callable[[list], dict[str, list]]],
    fields: list[tuple[str, str]],
    column: str = "text",
    keep: list[str] | None = None,
    whole: bool = False,
) -> DataFrame:
    """df with new columns that start()(texts) gives for slices of one text column.

    start() runs once in each task; the function it returns gets the slice's texts (UTF-8 bytes or None; with whole, one
    Arrow array of more rows) and returns a list or array for each new column. keep names the input columns to return (default: all). An input column with the name of a new
    one is replaced by it.
    """
    new = {n for n, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*kept, F.col(column).cast("string").cast("binary").alias("__text"))
    spark = df.sparkSession
    added = spark.createDataFrame([], extended(fields)).schema
    schema = source.drop("__text").schema
    for f in added:
        schema = schema.add(f)
    arrow = {f.name: pa_type(f.dataType.simpleString()) for f in added}
    names = [*kept, *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        sliced = ((p, p.column(len(kept))) for p in parts(batches)) if whole else texts(batches, "__text")
        for part, values in sliced:
            made = work(values)
            columns = [part.column(i) for i in range(len(kept))]
            columns += [pa.array(made[n], type=arrow[n]) for n, _ in fields]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def pa_type(name: str) -> pa.DataType:
    """The Arrow type of a Spark type that the operators return."""
    if name.startswith("array<"):
        return pa.list_(pa_type(name[6:-1]))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    }[name]
