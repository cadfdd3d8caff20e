"""Packed exchange between blocks of documents and shards of hashes.

Operators that compare every window or word of a corpus with every other move far more rows than documents. Here the
documents are packed once into blocks of a few MB of text (a table in the shared folder); what a block asks is sent as
one sorted, packed array of hashes to each shard of the hash space; a shard answers each block with an array in the
same order; and the answers are joined back to the blocks. Equal hashes of one block travel once, so a very common
word or passage costs one entry a block, and shards are as even as the hashes. The number of shards follows the
input's size, so a shard's share of it stays the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, pack, saved, texts, unpack

#: Raw text bytes of one bucket of blocks (a task's rows wait in memory together), and Spark's bound on buckets.
BUCKET_BYTES, MOST_BUCKETS = 6 << 20, 100_000
#: Raw text bytes for one shard. A text of this size asks for about two million hashes at the very most.
SHARD_BYTES = 16 << 20


def packed_blocks(
    docs: DataFrame,
    text: str,
    columns: list[str],
    name: str,
    start: Callable[[], Callable[[pa.Table], tuple[pa.Table, list[bytes]]]] | None = None,
    extra: tuple[str, ...] = (),
    buckets: int = 0,
) -> DataFrame:
    """A table of blocks: block, raw (text bytes), payload (packed rows with `columns` and __text); bucketed by block if
    buckets are asked for: answers written by bucketed_answers() then join it without a shuffle, so that exchanges
    don't move the blocks.

    start() gives a function that runs on each block's rows and returns the rows to keep instead, and what the extra
    columns hold. A block is cut when its texts reach BLOCK_BYTES; a longer text is a block of its own.
    """
    source = docs.select(*columns, F.col(text).cast("string").cast("binary").alias("__text"))
    names = ["block", "raw", "payload", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        work = start() if start else lambda rows: (rows, [])

        def block():
            nonlocal number
            rows, more = work(pa.Table.from_batches(held).combine_chunks())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            made = [pa.array([(task << 32) + number], pa.int64()), pa.array([size], pa.int64())]
            made += [pa.array([x], pa.binary()) for x in (pack(sink.getvalue().to_pybytes()), *more)]
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for part, values in texts(batches, "__text"):
            begin = 0
            for k, v in enumerate(values):
                size += len(v or b"") + 16
                if size >= BLOCK_BYTES:
                    held.append(part.slice(begin, k + 1 - begin))
                    yield block()
                    begin, size = k + 1, 0
            if begin < part.num_rows:
                held.append(part.slice(begin))
        if held:
            yield block()

    schema = "block bigint, raw bigint, " + ", ".join(f"{n} binary" for n in names[2:])
    blocks = source.mapInArrow(run, schema)
    return saved(blocks.repartition(buckets, "block"), name, "block", buckets) if buckets else saved(blocks, name)


def rows_of(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(unpack(payload)).read_all()


def shards_for(blocks: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """A power of two, so that a hash's high bits name its shard."""
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    return 1 << max(0, math.ceil(raw / shard_bytes) - 1).bit_length()


def buckets_for(docs: DataFrame, text: str) -> int:
    raw = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return min(MOST_BUCKETS, max(1, math.ceil(raw / BUCKET_BYTES)))


def bucketed_answers(answers: DataFrame, name: str, fields: tuple[str, ...], buckets: int) -> DataFrame:
    """block, `name` (array<struct<shard, fields>>): each block's answers by shard. Blocks under 0 are shards' extras."""
    per = answers.repartition(buckets, "block").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("shard", *fields))).alias(name))
    return saved(per, f"answers-{name}", "block", buckets)


def _planes(values: np.ndarray, width: int) -> list[bytes]:
    """The lowest bytes of all values, then the next ones, up to `width` of them."""
    raw, step = np.ascontiguousarray(values).view(np.uint8), values.dtype.itemsize
    return [raw[k::step].tobytes() for k in range(width)]


def _from_planes(planes: np.ndarray, kind) -> np.ndarray:
    """The values of these planes (a row for each); bytes above them are zero."""
    width, n = planes.shape
    step = np.dtype(kind).itemsize
    out = np.empty((n, step), np.uint8) if width == step else np.zeros((n, step), np.uint8)
    for k in range(width):
        out[:, k] = planes[k]
    return out.ravel().view(kind)


def put(values: np.ndarray) -> bytes:
    """An array, its bytes transposed (equal high bytes meet) and packed."""
    return pack(b"".join(_planes(values, values.dtype.itemsize))) if len(values) else b""


def get(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    return _from_planes(np.frombuffer(unpack(data), np.uint8).reshape(np.dtype(kind).itemsize, -1), kind)


def _width(values: np.ndarray) -> int:
    """Bytes up to the highest that isn't zero in all values; every byte of floats and negative numbers."""
    if values.dtype.kind == "f" or not len(values) or values.min() < 0:
        return values.dtype.itemsize
    return -(-int(values.max()).bit_length() // 8)


def bundles(arrays: list[np.ndarray], cuts: list[np.ndarray]) -> list[bytes]:
    """Messages of several arrays packed together: the k-th has each array's stretch from its k-th cut to the next. It holds
    their lengths and widths, then each one's bytes transposed, without high bytes that are zero in all of an array."""
    widths = [_width(a) for a in arrays]
    lengths = np.stack([np.diff(c) for c in cuts], 1)
    heads = np.stack([lengths, np.broadcast_to(widths, lengths.shape)], 2).astype(np.int64)
    planes = [(memoryview(p), np.asarray(c).tolist()) for a, w, c in zip(arrays, widths, cuts, strict=True) for p in _planes(a, w)]
    return [pack(b"".join([heads[k].tobytes(), *(p[c[k] : c[k + 1]] for p, c in planes)])) for k in range(len(heads))]


def unbundled(data: list[bytes], kinds: tuple) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays of messages, each joined over the messages; and their lengths in each one (a row for a message)."""
    raws = [memoryview(unpack(d)) for d in data]
    heads = [np.frombuffer(r, np.int64, 2 * len(kinds)).reshape(-1, 2).tolist() for r in raws]
    at, out = [16 * len(kinds)] * len(raws), []
    for j, kind in enumerate(kinds):
        parts = list(zip(raws, at, *zip(*(h[j] for h in heads), strict=True), strict=True)) if raws else []
        width = max((w for _, _, _, w in parts), default=0)
        planes = [b"".join([r[b + k * n : b + k * n + n] if k < w else bytes(n) for r, b, n, w in parts]) for k in range(width)]
        total = sum(n for _, _, n, _ in parts)
        out.append(_from_planes(np.frombuffer(b"".join(planes), np.uint8).reshape(width, total), kind))
        at = [b + n * w for _, b, n, w in parts]
    return out, np.array(heads, np.int64).reshape(-1, len(kinds), 2)[:, :, 0]


def put_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values by their steps."""
    return put(np.diff(values, prepend=np.uint64(0)))


def get_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(get(data, np.uint64), dtype=np.uint64)


def shard_runs(sorted_hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards that sorted hashes touch, and where each one's part begins; one more at the end. A hash's shard is
    its high bits, so the work follows the hashes, however many shards there are."""
    bits = shards.bit_length() - 1
    shard = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sorted_hashes), np.int64)
    begin = np.flatnonzero(np.diff(shard, prepend=-1))
    return shard[begin], np.append(begin, len(shard))


def ask(blocks: DataFrame, shards: int, question: Callable[[dict], tuple[np.ndarray, list[np.ndarray]]]) -> DataFrame:
    """shard, block, hashes, values: question(row of blocks) gives sorted distinct hashes and arrays beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                hashes, values = question(row)
                full, at = shard_runs(hashes, shards)
                cut = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full.astype(np.int32)),
                        pa.array([row["block"]] * len(full), pa.int64()),
                        pa.array([put_sorted(hashes[c]) for c in cut], pa.binary()),
                        pa.array([[put(v[c]) for v in values] for c in cut], pa.list_(pa.binary())),
                    ],
                    names=["shard", "block", "hashes", "values"],
                )

    return blocks.mapInArrow(run, "shard int, block bigint, hashes binary, values array<binary>")


def answer(asked: DataFrame, reply: Callable, kinds: list, names: tuple[str, ...] = ("data",)) -> DataFrame:
    """shard, block and the answers: reply(hashes, values, owner) sees all entries of a shard, sorted by hash and then by
    block (owner numbers the blocks), and returns (arrays of answers in that order, one for each of names; extra bytes
    or None). The extra bytes come as a row with block -1 - shard, under the first name."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids = table.column("block").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        parts = [get_sorted(table.column("hashes")[k].as_py()) for k in order]
        values = [np.concatenate([get(table.column("values")[k][j].as_py(), kind) for k in order]) for j, kind in enumerate(kinds)]
        lengths = [len(p) for p in parts]
        hashes = np.concatenate(parts)
        owner = np.repeat(np.arange(len(order)), lengths)
        by = np.argsort(hashes, kind="stable")  # stable: within a hash by block
        found, extra = reply(hashes[by], [v[by] for v in values], owner[by])
        back = [np.empty_like(f) for f in found]
        for to, f in zip(back, found, strict=True):
            to[by] = f
        ends = np.cumsum(lengths)
        out = [(ids[k], *(put(f[e - n : e]) for f in back)) for k, n, e in zip(order, lengths, ends, strict=True)]
        if extra is not None:
            out.append((-1 - shard, extra, *[b""] * (len(names) - 1)))
        columns = {"shard": pa.array([shard] * len(out), pa.int32()), "block": pa.array([x[0] for x in out], pa.int64())}
        return pa.table(columns | {n: pa.array([x[j] for x in out], pa.binary()) for j, n in enumerate(names, 1)})

    return asked.groupBy("shard").applyInArrow(run, "shard int, block bigint, " + ", ".join(f"{n} binary" for n in names))


def with_answers(blocks: DataFrame, answers: DataFrame, name: str, fields: tuple[str, ...] = ("data",)) -> DataFrame:
    """blocks with the column `name`: their answers by shard, as array<struct<shard, fields>>."""
    per = answers.where("block >= 0").groupBy(F.col("block").alias("__b")).agg(
        F.sort_array(F.collect_list(F.struct("shard", *fields))).alias(name))
    return blocks.join(per, F.col("block") == F.col("__b"), "left").drop("__b")


def joined(answers: list[dict] | None, kind, field: str = "data") -> np.ndarray:
    """A block's answers as one array, in the order of its sorted hashes."""
    return np.concatenate([get(a[field], kind) for a in answers]) if answers else np.empty(0, kind)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values, and the run number of each entry."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1
