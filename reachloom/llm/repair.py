"""Repairing conversations' structure with the fewest edits, by dynamic programming on grammar-compressed sequences.

A row is a symbol: its role's initial (s, u, a, or x for any other) with its fault, if that is to be deleted (d) or truncated
(capital). Edits turn a conversation into `(s?(ua)+)?`; between four states (nothing yet, a system turn, a user's turn that
waits, an answered one) each symbol has a min-plus matrix of the cheapest edits, inserts before it included, with their
audit: the edits' initials in order. Of equally cheap ones the audit that is least in ASCII stays. Audits of one matrix
have as many letters other than I as the part has rows and end in one, so none is a proper beginning of another, and the
choice agrees with putting parts together: the products are exact in any order.

Conversations are cut into segments of a bounded number of symbols. Equal segments, of whatever conversations, are one row.
Re-Pair finds symbols' pairs that come often in a block of them and gives each a rule; a rule has one matrix, made from its
two parts' matrices with its audits as ropes, bottom-up; a segment is the product of what is left of it. Conversations then
fold their segments' matrices in order, and a last pass over the texts, streamed by conversation, applies the edits.

Rows are taken by turn (nulls first), ties by role and a hash of the text. Equal rows of one turn are counted before they
are shuffled, and first occurrences come from minima, so that neither a very common row nor a very long conversation is
gathered; only its digest, which is sequential, streams through one task a slice of rows at a time.

Cases: a null role or text is one space (and such a text blank). Rows with a null conv_id are one conversation. A
conversation whose rows are all dropped has zeros, no edits and the digest of nothing; an empty table gives an empty
result. Repeated rows are duplicates. Very long texts are hashed whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, saved

#: What counts as white space.
WHITE = " \t\n\x0b\f\r"
#: Costs of edits, and of a truncated row that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Symbols of a segment, and of a block of segments that share a grammar.
SEGMENT, BLOCK = 4096, 1 << 16
#: Ropes up to this length are plain strings.
PLAIN = 64
STATES = 4  # nothing yet, a system turn, a user's turn that waits, an answered one
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

Rope = str | tuple
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def length(rope: Rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[0]


def join(a: Rope, b: Rope) -> Rope:
    n = length(a) + length(b)
    if n <= PLAIN:
        return text_of(a) + text_of(b)
    return a if not length(b) else b if not length(a) else (n, a, b)


def leaves(rope: Rope) -> Iterator[str]:
    held = [rope]
    while held:
        r = held.pop()
        if isinstance(r, str):
            yield r
        else:
            held += [r[2], r[1]]


def text_of(rope: Rope) -> str:
    return rope if isinstance(rope, str) else "".join(leaves(rope))


def less(a: Rope, b: Rope) -> bool:
    """a before b, leaf by leaf; shared parts are compared as long as they differ in place only."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    left, right, x, y = leaves(a), leaves(b), "", ""
    while True:
        x, y = x or next(left, ""), y or next(right, "")
        if not x or not y:
            return not x and bool(y)
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x < y
        x, y = x[n:], y[n:]


def better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and new[1] is not old[1] and less(new[1], old[1]))


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus: the cheapest way over any state between, the least audit of equally cheap ones."""
    out: Matrix = {}
    after: dict[int, list[tuple[int, tuple[int, Rope]]]] = {}
    for (i, j), entry in b.items():
        after.setdefault(i, []).append((j, entry))
    for (i, m), (cost, rope) in a.items():
        for j, (more, tail) in after.get(m, ()):
            old = out.get((i, j))
            if old is None or cost + more <= old[0]:
                new = (cost + more, join(rope, tail))
                if better(new, old):
                    out[i, j] = new
    return out


#: The cheapest inserts between states.
INSERTS: Matrix = {(i, i): (0, "") for i in range(STATES)}
INSERTS |= {(0, 2): (INSERT, "I"), (1, 2): (INSERT, "I"), (3, 2): (INSERT, "I"), (2, 3): (INSERT, "I")}
INSERTS |= {(0, 3): (2 * INSERT, "II"), (1, 3): (2 * INSERT, "II")}


def terminal(symbol: str) -> Matrix:
    """A row's matrix, inserts before it included."""
    row: Matrix = {(i, i): (DELETE, "D") for i in range(STATES)}
    if symbol != "d":
        late = TRUNCATED if symbol.isupper() else 0
        for role in "ua":
            for i, j in MOVES[role].items():
                row[i, j] = (REROLE + late, "R")
        for i, j in MOVES.get(symbol.lower(), {}).items():
            row[i, j] = (late, "K")
    return product(INSERTS, row)


SYMBOLS = "dsuaxSUAX"
TERMINALS = [terminal(c) for c in SYMBOLS]


def re_pair(sequences: list[str], pairs: int = 64) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (rule r stands for symbol len(SYMBOLS) + r and has two smaller symbols) and the sequences in them. In each round
    the most frequent pairs, up to `pairs` without a symbol in common, become rules, until none comes twice."""
    number = {c: k for k, c in enumerate(SYMBOLS)}
    flat = np.array([k for s in sequences for k in [*map(number.__getitem__, s), -1]], np.int64)
    rules: list[tuple[int, int]] = []
    while True:
        left, right = flat[:-1], flat[1:]
        whole = (left >= 0) & (right >= 0)
        size = len(SYMBOLS) + len(rules)
        codes, counts = np.unique(left[whole] * size + right[whole], return_counts=True)
        used: set[int] = set()
        chosen: dict[int, int] = {}
        for k in np.lexsort((codes, -counts)).tolist():
            if counts[k] < 2 or len(chosen) == pairs:
                break
            a, b = divmod(int(codes[k]), size)
            if a not in used and b not in used:
                used |= {a, b}
                chosen[int(codes[k])] = size + len(chosen)
                rules.append((a, b))
        if not chosen:
            break
        keys = np.array(sorted(chosen))
        code = np.where(whole, left * size + right, -1)
        at = np.flatnonzero(np.isin(code, keys))
        # pairs of one symbol may overlap: of a run every other one is taken
        first = np.ones(len(at), bool)
        first[1:] = np.diff(at) > 1
        run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        to = np.array([chosen[k] for k in keys.tolist()])
        flat[at] = to[np.searchsorted(keys, code[at])]
        stay = np.ones(len(flat), bool)
        stay[at + 1] = False
        flat = flat[stay]
    out: list[list[int]] = [[]]
    for k in flat.tolist():
        if k < 0:
            out.append([])
        else:
            out[-1].append(k)
    return rules, out[:-1]


def matrices(sequences: list[str]) -> list[Matrix]:
    """Each sequence's matrix: rules bottom-up, then the product of what is left."""
    rules, left = re_pair(sequences)
    of = list(TERMINALS)
    for a, b in rules:
        of.append(product(of[a], of[b]))
    out = []
    for symbols in left:
        made: Matrix = {(i, i): (0, "") for i in range(STATES)} if not symbols else of[symbols[0]]
        for k in symbols[1:]:
            made = product(made, of[k])
        out.append(made)
    return out


class Fold:
    """One conversation's cheapest edits, segment by segment."""

    def __init__(self) -> None:
        self.at: dict[int, tuple[int, Rope]] = {0: (0, "")}

    def step(self, matrix: Matrix) -> None:
        now: Matrix = product({(0, i): x for i, x in self.at.items()}, matrix)
        self.at = {j: x for (_, j), x in now.items()}

    def end(self) -> tuple[int, str]:
        self.step(INSERTS)
        best = None
        for state in (0, 3):
            if state in self.at and better(self.at[state], best):
                best = self.at[state]
        return best[0], text_of(best[1])


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows with faults put in, by crc32(`conv_id:turn`) % 20 (nulls: one space)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    rows = turns.select("conv_id", "turn", "role", "text", kind.alias("k"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, F.lit("user")).otherwise(part("role")).alias("role"), text.alias("text"),
        (F.col("k") == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped, and `h`, a 128-bit hash of conversation, role and text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), part("role").alias("role"), part("text").alias("text"), dropped.alias("dropped"))
    sized = F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text")
    return rows.withColumn("h", F.unhex(F.md5(sized.cast("binary"))))


def _segments(rows: DataFrame) -> DataFrame:
    """Rows in order, cut into segments: conv_id, segment, symbols, and counts and ends that meet when segments do."""
    ends = F.rtrim(F.col("text"), F.lit(WHITE))
    faulty = rows.select(
        "conv_id", "turn", "h", "dropped", F.substring("role", 1, 1).alias("initial"), F.sha2("role", 256).alias("r"),
        (ends == "").alias("blank"), (~F.substring(ends, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    # dropped rows count for their conversation only
    keys = {c: F.when(F.col("dropped"), F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("turn", "h", "initial", "r", "blank", "cut")}
    found = saved(faulty.select("conv_id", "dropped", *keys.values()).groupBy("conv_id", "dropped", *keys).agg(F.count(F.lit(1)).alias("n")), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    firsts = found.where("NOT dropped").groupBy("h").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("times"))
    marked = found.join(firsts.where("times > 1").select("h", "first"), "h", "left")
    later = ~F.coalesce(F.col("first").eqNullSafe(when), F.lit(True)) & F.col("first").isNotNull()
    marked = marked.select("conv_id", "turn", "r", "h", "dropped", "initial", "blank", "cut", "n", later.alias("later"))
    order = ["conv_id", "turn", "r", "h"]
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = (
        f"conv_id {kind}, segment bigint, symbols string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
        "first_initial string, last_initial string, least_turn bigint, most_turn bigint, turns bigint"
    )
    schema = rows.sparkSession.createDataFrame([], fields).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        conv, seg, kind_of, done = None, None, None, []

        def new() -> dict:
            return dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {
                "symbols": [], "size": 0, "first_initial": None, "last_initial": None, "least_turn": None, "most_turn": None
            }

        def close():
            nonlocal segment
            seg["symbols"] = "".join(seg["symbols"])
            done.append((conv, segment, seg))
            segment += 1

        def flush():
            columns = [pa.array([c for c, _, _ in done], kind_of), pa.array([k for _, k, _ in done], pa.int64())]
            for f in schema.fields[2:]:
                columns.append(pa.array([s[f.name] for _, _, s in done], pa.string() if f.dataType.simpleString() == "string" else pa.int64()))
            batch = pa.RecordBatch.from_arrays(columns, names=schema.names)
            done.clear()
            return batch

        for batch in batches:
            kind_of = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if seg is None or row["conv_id"] != conv:
                    if seg is not None:
                        close()
                    conv, seg = row["conv_id"], new()
                if row["dropped"]:
                    continue
                initial, left, first = row["initial"], row["n"], True
                symbol = initial if initial in ("s", "u", "a") else "x"
                while left:
                    if seg["size"] == SEGMENT:
                        close()
                        seg = new()
                    some = min(left, SEGMENT - seg["size"])
                    seg["size"] += some
                    left -= some
                    if row["blank"]:
                        seg["symbols"].append("d" * some)
                        seg["blank"] += some
                    elif row["later"] or not first:
                        seg["symbols"].append("d" * some)
                        seg["duplicate"] += some
                    else:
                        seg["symbols"].append((symbol.upper() if row["cut"] else symbol) + "d" * (some - 1))
                        seg["truncated"] += row["cut"]
                        seg["duplicate"] += some - 1
                    if seg["last_initial"] is None:
                        seg["first_initial"] = initial
                    else:
                        seg["illegal"] += seg["last_initial"] + initial not in ("su", "ua", "au")
                    seg["illegal"] += some - 1
                    seg["last_initial"], first = initial, False
                    turn = row["turn"]
                    if turn is not None and turn != seg["most_turn"]:
                        seg["turns"] += 1
                        seg["least_turn"] = turn if seg["least_turn"] is None else seg["least_turn"]
                        seg["most_turn"] = turn
                if len(done) >= 2000:
                    yield flush()
        if seg is not None:
            close()
        if done:
            yield flush()

    return saved(ordered.mapInArrow(run, schema), "segments")


def _evaluated(segments: DataFrame) -> DataFrame:
    """Each different segment's matrix: symbols, entry (16 * from + to), cost and audit."""
    schema = segments.sparkSession.createDataFrame([], "symbols string, entries array<struct<i:int,j:int,cost:bigint,audit:string>>").schema
    entry = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block():
            made = [
                [{"i": i, "j": j, "cost": c, "audit": text_of(r)} for (i, j), (c, r) in m.items()] for m in matrices(held)
            ]
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(made, entry)], names=schema.names)

        for batch in batches:
            for s in batch.column(0).to_pylist():
                held.append(s)
                size += len(s) + 1
                if size >= BLOCK:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return segments.select("symbols").distinct().sortWithinPartitions("symbols").mapInArrow(run, schema)


def repair_plans(turns: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit. Columns of `turns`:
    conv_id, turn, role, text, and `dropped` (rows that are gone, whose conversation counts) if there is one."""
    segments = _segments(_rows(turns))
    full = segments.join(_evaluated(segments), "symbols")
    full = full.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    kind = segments.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    schema = turns.sparkSession.createDataFrame([], fields).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, kind_of, done = None, None, None, []

        def close():
            cost, audit = now["fold"].end()
            gaps = now["most_turn"] - now["least_turn"] + 1 - now["turns"] if now["turns"] else 0
            done.append([conv, gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], cost, audit])

        def flush():
            types = [kind_of, *[pa.int64()] * 6, pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types, strict=True)], names=schema.names)
            done.clear()
            return batch

        for batch in batches:
            kind_of = batch.schema.field("conv_id").type
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for s in batch.slice(at, SLICE_ROWS).to_pylist():
                    if now is None or s["conv_id"] != conv:
                        if now is not None:
                            close()
                        conv = s["conv_id"]
                        now = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
                        now |= {"fold": Fold(), "last": None, "least_turn": None, "most_turn": None}
                    for n in ("blank", "duplicate", "truncated", "illegal", "turns"):
                        now[n] += s[n]
                    if s["turns"]:
                        now["turns"] -= s["least_turn"] == now["most_turn"]
                        now["least_turn"] = s["least_turn"] if now["least_turn"] is None else now["least_turn"]
                        now["most_turn"] = s["most_turn"]
                    if s["first_initial"] is not None:
                        now["illegal"] += now["last"] is not None and now["last"] + s["first_initial"] not in ("su", "ua", "au")
                        now["last"] = s["last_initial"]
                    now["fold"].step({(e["i"], e["j"]): (e["cost"], e["audit"]) for e in s["entries"]})
                if len(done) >= 2000:
                    yield flush()
        if now is not None:
            close()
        if done:
            yield flush()

    return full.mapInArrow(run, schema)


class Edits:
    """Applies an audit to a conversation's rows, one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _turn(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = 3 if self.state == 2 else 2
        return role

    def inserts(self) -> list[tuple[str, str]]:
        """The empty turns that come next."""
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            out.append((self._turn(), ""))
        return out

    def row(self, role: str, text: str) -> list[tuple[str, str]]:
        """The turns that a row leaves, inserts before it included."""
        out = self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            out.append((self._turn(), text))
        elif edit == "K":
            self.state = MOVES[role[:1]][self.state]
            out.append((role, text))
        return out


def _streamed(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan and after it its rows in order: conv_id, head, role, text, and the plan's columns."""
    rest = [c for c in plans.columns if c not in ("conv_id", "audit")]
    heads = plans.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("r"), F.lit(None).cast("binary").alias("h"),
        F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.struct(*rest).alias("plan"),
    )
    rows = _rows(turns).where("NOT dropped").select(
        "conv_id", F.lit(1).alias("kind"), "turn", F.sha2("role", 256).alias("r"), "h", "role", "text", F.lit(None).cast(heads.schema["plan"].dataType).alias("plan")
    )
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "r", "h")
    return both.select("conv_id", "kind", "role", "text", "plan")


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text."""
    kind = plans.schema["conv_id"].dataType.simpleString()
    schema = turns.sparkSession.createDataFrame([], f"conv_id {kind}, position bigint, role string, text string").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits, position, kind_of = None, None, 0, None

        def made(given: list[tuple[str, str]]) -> list[list]:
            nonlocal position
            position += len(given)
            return [[conv, position - len(given) + k, *turn] for k, turn in enumerate(given)]

        def batch_of(out: list[list]) -> pa.RecordBatch:
            types = [kind_of, pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            kind_of = batch.schema.field("conv_id").type
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = []
                for row in batch.slice(at, SLICE_ROWS).to_pylist():
                    if row["kind"] == 0:
                        out += made(edits.inserts()) if edits else []
                        conv, edits, position = row["conv_id"], Edits(row["text"]), 0
                    else:
                        out += made(edits.row(row["role"], row["text"]))
                if out:
                    yield batch_of(out)
        if edits and (out := made(edits.inserts())):
            yield batch_of(out)

    return _streamed(turns, plans).mapInArrow(run, schema)


def digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans with repaired_sha256 (of the repaired `role:text` lines, joined by newlines)."""
    names = [c for c in plans.columns if c != "repaired_sha256"]
    schema = turns.sparkSession.createDataFrame([], "repaired_sha256 string").schema
    out_schema = plans.select(*names).schema.add(schema[0])
    rest = [c for c in names if c not in ("conv_id", "audit")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, edits, digest, lines, types, done = None, None, None, 0, None, []

        def put(given: list[tuple[str, str]]) -> None:
            nonlocal lines
            for role, text in given:
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                lines += 1

        def close():
            put(edits.inserts())
            done.append([{"conv_id": head["conv_id"], "audit": head["text"], **head["plan"]}[n] for n in names] + [digest.hexdigest()])

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types, strict=True)], names=[*names, "repaired_sha256"])
            done.clear()
            return batch

        for batch in batches:
            if types is None:
                plan = batch.schema.field("plan").type
                of = {"conv_id": batch.schema.field("conv_id").type, "audit": pa.string()} | {c: plan.field(c).type for c in rest}
                types = [*(of[n] for n in names), pa.string()]
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for row in batch.slice(at, SLICE_ROWS).to_pylist():
                    if row["kind"] == 0:
                        if edits:
                            close()
                        head, edits, digest, lines = row, Edits(row["text"]), hashlib.sha256(), 0
                    else:
                        put(edits.row(row["role"], row["text"]))
                if len(done) >= 2000:
                    yield flush()
        if edits:
            close()
        if done:
            yield flush()

    return _streamed(turns, plans).mapInArrow(run, out_schema)


def repair(turns: DataFrame) -> DataFrame:
    """Plans and digests of conversations."""
    return digests(turns, saved(repair_plans(turns), "plans"))
