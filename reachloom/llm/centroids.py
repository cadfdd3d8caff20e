"""Centroid clustering of integer vectors by scalar lookup tables.

A vector's components are floor(scale * x). Vectors are packed once into blocks of a bounded number of rows: for each
dimension the integer values that occur in the block, in order, and each row's place among them. In a round a task
tabulates, for its block, the squared difference of every dimension, occurring value and centroid; distances are gathers
from these tables and sums of what is gathered. Sums by cluster come from counts of (cluster, place) in the same way, leave a
task as one row for each cluster, and meet in Spark; the driver gets k rows of sums. Rounds that change no centroid end the
loop, as all further ones would be alike.

Everything is in whole numbers. Values beyond SMALL are handled as Python's unbounded integers, and sums travel in parts of
PART bits, as many as the largest value in the table asks for.

Cases: vectors that are null, of another length, or with a null or non-finite component are left out. With fewer kept
vectors than centroids, each of them is a centroid; without any the result is empty. Repeated rows are vectors of their
own. A null id comes after all others when the first centroids are drawn; equal ids by components. A distance or inertia
that doesn't fit a long is null. Columns named like those of the result are replaced by them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Vectors of one block.
BLOCK_ROWS = 8192
#: Components under this in size are summed and squared as 64-bit numbers: 64 squares of a difference then stay under 2 ** 62.
SMALL = 1 << 27
#: Bits of a part of a sum; eight million tasks may add theirs up in a long.
PART = 40

BLOCK = "n int, top int, wide boolean, counts binary, occurring binary, places binary"


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly, also where the product has no double."""
    return math.floor(scale * x) if math.isfinite(scale * x) else math.floor(x) * scale


def integers(flat: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles as an array of vectors: 64-bit numbers, or Python's if one isn't small."""
    with np.errstate(over="ignore"):
        v = np.floor(scale * flat)
    if len(v) == 0 or np.abs(v).max() < SMALL:
        return v.astype(np.int64).reshape(-1, dims)
    return np.array([whole(x, scale) for x in flat.tolist()], object).reshape(-1, dims)


def block_of(vectors: np.ndarray) -> list:
    """The fields of BLOCK."""
    wide = vectors.dtype == object
    counts, occurring, places = [], [], []
    for column in vectors.T:
        values, place = np.unique(column, return_inverse=True)
        counts.append(len(values))
        occurring += values.tolist()
        places.append(place.reshape(-1).astype("<u2"))
    top = max((abs(v).bit_length() for v in occurring), default=0)
    data = ",".join(map(str, occurring)).encode() if wide else np.array(occurring, "<i8").tobytes()
    return [len(vectors), top, wide, np.array(counts, "<u4").tobytes(), data, np.concatenate(places).tobytes()]


class Block:
    """A block read back."""

    def __init__(self, row: dict, dims: int):
        self.n, self.dims = row["n"], dims
        if row["wide"]:
            values = np.array([int(x) for x in row["occurring"].split(b",")], object)
        else:
            values = np.frombuffer(row["occurring"], "<i8")
        ends = np.cumsum(np.frombuffer(row["counts"], "<u4"))
        self.values = np.split(values, ends[:-1])
        self.places = np.frombuffer(row["places"], "<u2").reshape(dims, self.n)

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest centroid (the smaller number of equally near ones) and its squared distance."""
        far = any(abs(x) >= SMALL for c in centroids for x in c) or self.values[0].dtype == object
        points = np.array(centroids, object if far else np.int64)
        distance = np.zeros((self.n, len(centroids)), points.dtype)
        for d in range(self.dims):
            table = (self.values[d].astype(points.dtype)[:, None] - points[None, :, d]) ** 2
            distance += table[self.places[d]]
        cluster = distance.argmin(1)
        return cluster, distance[np.arange(self.n), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """The componentwise sums of each cluster's rows."""
        out = np.zeros((k, self.dims), object)
        for d, values in enumerate(self.values):
            m = len(values)
            seen = np.bincount(cluster * m + self.places[d], minlength=k * m).reshape(k, m)
            out[:, d] = seen.astype(values.dtype).dot(values)
        return out


def split(x: int, parts: int) -> list[int]:
    """x in parts of PART bits, the last one with the sign."""
    return [*((x >> (PART * i)) & ((1 << PART) - 1) for i in range(parts - 1)), x >> (PART * (parts - 1))]


def joined(parts: list[int]) -> int:
    return sum(x << (PART * i) for i, x in enumerate(parts))


def long_or_none(x: int) -> int | None:
    return int(x) if -(1 << 63) <= x < 1 << 63 else None


def first_centroids(kept: DataFrame, k: int, seed: str, vec_id: str, scale: int) -> list[list[int]]:
    """The k vectors whose `seed:id` has the smallest SHA-256."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")), 256).alias("h")
    rows = kept.select(drawn, F.col("__v").alias("v")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return [[whole(float(x), scale) for x in r["v"]] for r in rows]


def cluster_vectors(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: str = "3",
    vec_id: str = "vec_id",
    column: str = "embedding",
    keep: list[str] | None = None,
) -> DataFrame:
    """The kept columns (default: all but the vector) of kept vectors with cluster, distance, cluster_inertia, inertia and
    centroid_sha256."""
    spark = vectors.sparkSession
    new = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    kept = [c for c in (vectors.columns if keep is None else keep) if c not in new and (keep is not None or c != column)]
    good = lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False))
    as_doubles = F.col(column).cast("array<double>")
    usable = vectors.where((F.size(column) == dims) & F.forall(as_doubles, good))
    centroids = first_centroids(usable.select(vec_id, as_doubles.alias("__v")), k, seed, vec_id, scale)

    rows = usable.select(F.struct(*kept).alias("r"), as_doubles.alias("v"))
    row_type = rows.schema["r"].dataType
    schema = spark.createDataFrame([], BLOCK).schema.add("rows", rows.select(F.array("r")).schema[0].dataType)

    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                flat = np.asarray(part.column(1).flatten(), np.float64)
                fields = block_of(integers(flat, dims, scale))
                types = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
                held = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                columns = [pa.array([x], t) for x, t in zip(fields, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, held], names=[*schema.names])

    blocks = saved(rows.mapInArrow(pack_blocks, schema), "vectors")
    top = blocks.agg(F.max("top")).first()[0] or 0
    parts = -(-(top + 60) // PART)  # a sum of 2 ** 50 values, and some room
    far = -(-(2 * top + 70) // PART)  # of squared distances

    def totals(points: list[list[int]]) -> dict[int, list]:
        """cluster -> number of rows, inertia, sums; a row for each cluster comes to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, inertia = [0] * len(points), [0] * len(points)
            sums = np.zeros((len(points), dims), object)
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row, dims)
                    cluster, distance = block.nearest(points)
                    sums += block.sums(cluster, len(points))
                    for c in range(len(points)):
                        mine = distance[cluster == c]
                        n[c] += len(mine)
                        inertia[c] += int(sum(mine.tolist()))
            out = [[n[c], *split(inertia[c], far), *(y for x in sums[c] for y in split(int(x), parts))] for c in range(len(points)) if n[c]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c in range(len(points)) if n[c]], pa.int32()), pa.array(out, pa.list_(pa.int64()))], names=["c", "s"]
            )

        some = blocks.drop("rows").mapInArrow(run, "c int, s array<bigint>")
        width = 1 + far + parts * dims
        found: dict[int, list] = {}
        for r in some.select("c", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x")).collect():
            found.setdefault(r["c"], [0] * width)[r["i"]] = r["x"]
        at = 1 + far
        return {c: [s[0], joined(s[1:at]), [joined(s[i : i + parts]) for i in range(at, width, parts)]] for c, s in found.items()}

    for _ in range(rounds):
        before, centroids = centroids, list(centroids)
        for c, (n, _, sums) in totals(centroids).items() if centroids else ():
            centroids[c] = [x // n for x in sums]
        if centroids == before:
            break
    last = totals(centroids) if centroids else {}
    inertia = long_or_none(sum(x[1] for x in last.values()))
    of = [long_or_none(last[c][1]) if c in last else None for c in range(len(centroids))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    result = spark.createDataFrame([], "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string").schema
    out_schema = usable.select(*kept).schema
    for f in result:
        out_schema = out_schema.add(f)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.names.index("rows")
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                block = Block({n: one.column(j)[0].as_py() for j, n in enumerate(schema.names) if j != at}, dims)
                cluster, distance = block.nearest(centroids)
                held = one.column(at).flatten()
                columns = [held.field(j) for j in range(len(kept))]
                columns += [
                    pa.array(cluster.astype(np.int32)),
                    pa.array([long_or_none(x) for x in distance.tolist()], pa.int64()),
                    pa.array([of[c] for c in cluster.tolist()], pa.int64()),
                    pa.array([inertia] * block.n, pa.int64()),
                    pa.array([hashes[c] for c in cluster.tolist()], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    assert row_type.names == kept
    return blocks.mapInArrow(answer, out_schema)
