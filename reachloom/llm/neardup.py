"""MinHash near-deduplication with sequential Bayesian verification.

A document's set is its distinct runs of `words` consecutive words (A-Z lower-cased); a document of fewer words has its
whole sequence as the one member. Documents of equal sets form classes (128-bit hashes of the set and its size), so
exact copies cost one row. Class representatives get BANDS bands of ROWS minima each; two sets of similarity 0.8 share
no band with a probability of (1 - 0.8^ROWS)^BANDS, about 2e-5, while texts that only share a common passage (similarity
0.5, say) seldom do.

Candidates are compared in rounds that together cover every pair that shares a band and isn't connected already:
1. each class with the first one of each of its buckets; 2. in buckets that then still hold several components, each
class outside the bucket's largest component with one of DRAWN drawn members of it, DRAWN_ROUNDS times; 3. each class
still outside with every class of another component (_links_in_buckets). Round 3 compares and verifies inside tasks
that hold two groups of a bucket's classes, bounded by bytes; a pair that shares several bands is looked at in the
first of them only, and a task gives at most one link for two components, so no pair becomes a row of its own.

Of each minimum a signature keeps the low 8 bits: two minima then agree by chance once in 256, which the match
probability takes into account. A candidate's signatures are compared STEP minima at a time; it is pruned as soon as the posterior probability (uniform
prior) that the similarity reaches the threshold falls below `miss` divided by the number of looks, so that all looks
together miss a pair at the threshold with a probability of about `miss`. Survivors are verified exactly on full sets,
rebuilt from the texts. Links are closed to components by label passing with stars (operators/graph.py).

Cases: null, empty and wordless texts have empty sets and link with nothing. Ids are whole numbers; a null id counts as
the largest. Rows are documents of their own: repeated rows share class and component and all come back, and rows of
one id with different texts are judged each by its own text. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import WordHash, pack, saved, texts, unpack, window_hashes

ROWS = 8
BANDS = 60
MINIMA = ROWS * BANDS
#: Minima that pairs are compared by, and how many at a time.
COMPARED = 480
STEP = 24
#: Bytes (signatures and packed texts) of a bucket's classes that one side of an in-task comparison holds.
GROUP_BYTES = 512 << 10
#: Rounds in which classes outside a bucket's largest component meet one drawn member of it, and members to draw from.
DRAWN_ROUNDS = 2
DRAWN = 4
SCALES = np.random.RandomState(7).randint(0, 2**32, (2, MINIMA), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
NO_ID = 2**63 - 1


def shingle_sets(bodies: list[bytes | None], words: int, hashed: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one text after another, and the sets' sizes."""
    sets, sizes = [], []
    for body in bodies:
        w = body.lower().split() if body else []
        h = hashed(w)
        one = window_hashes(h, words) if len(w) >= words else window_hashes(h, len(w), len(w)) if w else np.empty(0, np.uint64)
        one = np.unique(one)
        sets.append(one)
        sizes.append(len(one))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.array(sizes, np.int64)


def signatures(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MINIMA minima of each (non-empty) set."""
    starts = np.cumsum(sizes) - sizes
    low, high = (members & np.uint64(0xFFFFFFFF)).astype(np.uint32), (members >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sizes), MINIMA), np.uint32)
    for i in range(MINIMA):
        x = low * SCALES[0, i]
        x ^= high * SCALES[1, i]
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """For 0, STEP, 2 STEP, ... compared minima: the fewest equal ones at which P(similarity >= threshold) is at least
    miss divided by the number of looks.

    With a uniform prior the match probability's posterior after m of n equal minima is Beta(m + 1, n - m + 1); its
    upper tail is the chance of at most m successes in n + 1 draws at the threshold's match probability.
    """
    threshold += (1 - threshold) / 256
    out, miss = [0], miss / (COMPARED // STEP)
    for n in range(STEP, COMPARED + 1, STEP):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def _prepared(docs: DataFrame, words: int, text: str, id_column: str, carry: list[str]) -> DataFrame:
    """A saved row for each document: row (a number), id, the carried columns, a, b (hashes of its set), n_shingles;
for the slice's first row of each set also minima (low 8 bits), bands, marks (their low 16 bits) and the text packed."""
    carried = [F.col(c).alias(f"__carry_{c}") for c in carry]
    source = docs.select(
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID)).alias("id"), *carried,
        F.col(text).cast("string").cast("binary").alias("__text"),
    )
    before = source.columns[:-1]

    def run(batches):
        hashed = WordHash()
        for part, bodies in texts(batches, "__text"):
            ids = part.column(0).to_pylist()
            members, sizes = shingle_sets(bodies, words, hashed)
            ends = np.cumsum(sizes)
            prints = [xxhash.xxh3_128_intdigest(members[e - n : e].tobytes()) if n else 0 for e, n in zip(ends, sizes, strict=True)]
            first: dict[int, int] = {}
            for k in sorted(range(len(ids)), key=lambda k: ids[k]):
                if sizes[k]:
                    first.setdefault(prints[k], k)
            chosen = np.array(sorted(first.values()), np.int64)
            minima: list = [None] * len(ids)
            bands: list = [None] * len(ids)
            marks: list = [None] * len(ids)
            packed: list = [None] * len(ids)
            if len(chosen):
                inside = np.repeat(np.isin(np.arange(len(ids)), chosen), sizes)
                made = signatures(members[inside], sizes[chosen])
                grouped = made.reshape(len(chosen), BANDS, ROWS).astype(np.uint64)
                keys = np.full((len(chosen), BANDS), np.uint64(1)) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for r in range(ROWS):
                    keys = (keys ^ grouped[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
                    keys ^= keys >> np.uint64(32)
                low = made[:, :COMPARED].astype(np.uint8)
                for j, k in enumerate(chosen):
                    minima[k], bands[k], packed[k] = low[j].tobytes(), keys[j].view(np.int64), pack(bodies[k])
                    marks[k] = keys[j].astype(np.uint16).tobytes()
            half = lambda x, s: np.array([(p >> s) & (2**64 - 1) for p in x], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(i) for i in range(len(before))),
                    pa.array(half(prints, 0)),
                    pa.array(half(prints, 64)),
                    pa.array(sizes),
                    pa.array(minima, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(marks, pa.binary()),
                    pa.array(packed, pa.binary()),
                ],
                names=[*before, "a", "b", "n_shingles", "minima", "bands", "marks", "packed"],
            )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    schema = f"{kinds} a bigint, b bigint, n_shingles bigint, minima binary, bands array<bigint>, marks binary, packed binary"
    return saved(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "near-sets")


def _likely(pairs: DataFrame, signed: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (x, y) that the signatures don't rule out."""
    least = least_matches(threshold, miss)
    both = pairs.join(signed.select(F.col("node").alias("x"), F.col("minima").alias("mx")), "x")
    both = both.join(signed.select(F.col("node").alias("y"), F.col("minima").alias("my")), "y").select("x", "y", "mx", "my")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mx, my = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COMPARED) for i in (2, 3))
            alive = np.arange(batch.num_rows)
            equal = np.zeros(batch.num_rows, np.int64)
            for step, least_equal in enumerate(least[1:]):
                at = slice(step * STEP, (step + 1) * STEP)
                equal[alive] += (mx[alive, at] == my[alive, at]).sum(1)
                alive = alive[equal[alive] >= least_equal]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in (0, 1)], names=["x", "y"])

    return both.mapInArrow(run, "x bigint, y bigint")


def _links_in_buckets(mixed: DataFrame, signed: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """x, y: links between classes of different components that share a bucket, at most one for two components in a
    task, and enough of them that the components come out as if all pairs had been compared.

    mixed: bucket, band, node, component, main (the bucket's largest component), bytes. Every pair has at least one
    class outside main, so the few outside meet all. Both sides are dealt by a hash into groups of about GROUP_BYTES,
    and each group of the few goes to every group of the many: a task gets one pair of groups at a time.
    """
    least = least_matches(percent / 100, miss)
    outside = F.col("component") != F.col("main")
    groups = lambda v: F.greatest(F.lit(1), F.ceil(F.sum(v) / GROUP_BYTES)).cast("int")
    dealt = mixed.groupBy("bucket").agg(groups(F.when(outside, F.col("bytes")).otherwise(0)).alias("fews"), groups(F.col("bytes")).alias("manys"))
    rows = mixed.join(saved(dealt, "near-dealt"), "bucket").join(signed, "node")
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(11)), F.col(n)).cast("int")
    members = F.collect_list(F.struct("node", "component", "minima", "marks", "packed"))
    few = rows.where(outside).groupBy("bucket", place("fews").alias("k")).agg(members.alias("few"), F.first("manys").alias("manys"))
    few = few.select("bucket", F.explode(F.sequence(F.lit(0), F.col("manys") - 1)).alias("place"), "few")
    many = rows.groupBy("bucket", place("manys").alias("place")).agg(
        members.alias("many"), F.first("main").alias("main"), F.first("band").alias("band"))
    both = few.join(many, ["bucket", "place"]).select("few", "many", "main", "band")

    def side(column, k: int):
        nodes, parts, minima, marks, packed = column[k].values.flatten()
        minima = np.frombuffer(b"".join(minima.to_pylist()), np.uint8).reshape(-1, COMPARED)
        return nodes.to_numpy(), parts.to_numpy(), minima, np.frombuffer(b"".join(marks.to_pylist()), np.uint16).reshape(-1, BANDS), packed

    def run(batches):
        hashed = WordHash()
        for batch in batches:
            xs, ys = [], []
            for k in range(batch.num_rows):
                (i, ci, mi, bi, ti), (j, cj, mj, bj, tj) = side(batch.column(0), k), side(batch.column(1), k)
                main, band = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                a, b = np.nonzero((ci[:, None] != cj[None, :]) & ((cj == main)[None, :] | (i[:, None] < j[None, :])))
                equal = np.zeros(len(a), np.int64)
                for step, least_equal in enumerate(least[1:]):
                    at = slice(step * STEP, (step + 1) * STEP)
                    equal += (mi[a, at] == mj[b, at]).sum(1)
                    good = equal >= least_equal
                    a, b, equal = a[good], b[good], equal[good]
                # The first band that both share by its mark and its minima; if it's another one, another bucket has the pair.
                same = (mi[a] == mj[b]).reshape(-1, BANDS, ROWS).all(2) & (bi[a] == bj[b])
                here = same.argmax(1) == band
                a, b, equal = a[here], b[here], equal[here]
                joined: dict[int, int] = {}
                sets: dict[tuple[int, int], np.ndarray] = {}

                def root(c: int, joined=joined) -> int:
                    while c in joined:
                        c = joined[c]
                    return c

                def members_of(s: int, at: int, sets=sets, packed=(ti, tj)) -> np.ndarray:
                    if (s, at) not in sets:
                        sets[s, at] = shingle_sets([unpack(packed[s][at].as_py())], words, hashed)[0]
                    return sets[s, at]

                for p in np.argsort(-equal, kind="stable"):  # likely ones first: they spare others
                    u, v = root(int(ci[a[p]])), root(int(cj[b[p]]))
                    if u == v:
                        continue
                    x, y = members_of(0, int(a[p])), members_of(1, int(b[p]))
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        joined[u] = v
                        xs.append(int(i[a[p]]))
                        ys.append(int(j[b[p]]))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return both.mapInArrow(run, "x bigint, y bigint")


def _verified(pairs: DataFrame, signed: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity: 100 * intersection >= percent * union."""
    sets = signed.select("node", "packed")
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("packed").alias("tx")), "x")
    both = both.join(sets.select(F.col("node").alias("y"), F.col("packed").alias("ty")), "y").select("x", "y", "tx", "ty")

    def run(batches):
        hashed, last = WordHash(), (None, None)
        for batch in batches:
            good = []
            for k in range(batch.num_rows):
                tx, ty = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                if last[0] != ty:  # rows come by y: its set is used again
                    last = (ty, shingle_sets([unpack(ty)], words, hashed)[0])
                x, y = shingle_sets([unpack(tx)], words, hashed)[0], last[1]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    good.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(good, pa.int64())) for i in (0, 1)], names=["x", "y"])

    return both.mapInArrow(run, "x bigint, y bigint")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    miss: float = 1e-4,
    text: str = "text",
    id_column: str = "doc_id",
    carry: list[str] | None = None,
) -> DataFrame:
    """A row for each document: id, n_shingles, component_id (smallest id reachable), kept (id = component_id), and the
    columns in carry whose names aren't taken."""
    extra = [c for c in carry or [] if c not in (id_column, "n_shingles", "component_id", "kept")]
    prepared = _prepared(docs, words, text, id_column, extra)
    kinds = ["a", "b", "n_shingles"]
    node = F.min(F.when(F.col("minima").isNotNull(), F.col("row"))).alias("node")
    classes = prepared.where("n_shingles > 0").groupBy(*kinds).agg(F.min("id").alias("least"), node)
    classes = saved(classes, "near-classes")
    signed = prepared.where("minima IS NOT NULL").select(F.col("row").alias("node"), "minima", "bands", "marks", "packed")
    signed = signed.join(classes.select("node"), "node", "left_semi")
    buckets = signed.select("node", (F.length("packed") + 700).alias("bytes"), F.posexplode("bands").alias("band", "bucket"))
    counts = buckets.groupBy("bucket").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = saved(buckets.join(counts.select("bucket", "lead"), "bucket"), "near-buckets")
    signed = saved(signed.drop("bands").join(members.select("node").distinct(), "node", "left_semi"), "near-signed")

    def linked(pairs: DataFrame) -> DataFrame:
        likely = saved(_likely(pairs, signed, percent / 100, miss), "near-likely")  # one Python worker a task at a time
        return saved(_verified(likely, signed, words, percent), "near-links")

    def closed(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        if labels is not None:
            links = links.unionByName(labels.select(F.col("id").alias("x"), F.col("component").alias("y")))
        return components(links, "x", "y")

    def mixed_buckets(labels: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with the bucket's largest one as main."""
        held = members.join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
        held = held.select("bucket", "band", "node", "bytes", F.coalesce("component", "node").alias("component"))
        per = held.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        main = per.groupBy("bucket").agg(F.max(F.struct("n", F.negative("component").alias("c"))).alias("top"), F.count(F.lit(1)).alias("parts"))
        main = main.where("parts > 1").select("bucket", (-F.col("top.c")).alias("main"))
        return saved(held.join(main, "bucket"), "near-mixed")

    first = members.where("node > lead").select(F.col("lead").alias("x"), F.col("node").alias("y")).distinct()
    labels = closed(linked(first))
    for k in range(DRAWN_ROUNDS):
        mixed = mixed_buckets(labels)
        draws = [F.min(F.struct(F.xxhash64("node", "bucket", F.lit(k * DRAWN + d)).alias("h"), "node"))["node"] for d in range(DRAWN)]
        drawn = mixed.where("component = main").groupBy("bucket").agg(F.array(*draws).alias("drawn"))
        some = F.get("drawn", F.pmod(F.xxhash64("node", "bucket", F.lit(k)), F.lit(DRAWN)).cast("int"))
        pairs = mixed.where("component != main").join(drawn, "bucket").select("node", some.alias("j"))
        pairs = pairs.select(F.least("node", "j").alias("x"), F.greatest("node", "j").alias("y")).distinct()
        labels = closed(linked(pairs), labels)
    links = saved(_links_in_buckets(mixed_buckets(labels), signed, words, percent, miss), "near-links")
    labels = closed(links, labels)

    grouped = classes.join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    smallest = grouped.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("__least"))
    named = grouped.join(saved(smallest, "near-smallest"), "component", "left").select(
        *(F.col(c).alias(f"__{c}") for c in kinds), F.coalesce("__least", "least").alias("__component"))
    rows = prepared.select("id", *(f"__carry_{c}" for c in extra), *kinds)
    same = [F.col(c) == F.col(f"__{c}") for c in kinds]
    found = rows.where("n_shingles > 0").join(saved(named, "near-named"), same, "left").drop(*(f"__{c}" for c in kinds))
    found = found.unionByName(rows.where("n_shingles = 0").withColumn("__component", F.col("id")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(
        real("id").alias(id_column), "n_shingles", real("__component").alias("component_id"),
        (F.col("id") == F.col("__component")).alias("kept"), *(F.col(f"__carry_{c}").alias(c) for c in extra),
    )
