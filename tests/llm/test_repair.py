"""Conversation repair against a plain search over all edits, from the end backwards."""

import functools
import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from reachloom.llm import queries, repair

WHITE = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(symbols):
    """(cost, audit) by trying every edit from each place and state."""

    @functools.cache
    def best(k, state, inserts):
        found = []
        if k == len(symbols) and state in (0, 3):
            found.append((0, ""))
        add = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1])) if rest else None
        if inserts < 3:
            add(3, "I", best(k, 3 if state == 2 else 2, inserts + 1))
        if k < len(symbols):
            initial, fault = symbols[k]
            add(4, "D", best(k + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                late = 3 if fault == "truncated" else 0
                add(3 + late, "R", best(k + 1, 3 if state == 2 else 2, 0))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state))
                if to is not None:
                    add(late, "K", best(k + 1, to, 0))
        return min(found, default=None)

    for k in range(len(symbols), 0, -1):  # from the end, so that the search stays shallow
        for state in range(4):
            best(k, state, 0)
    return best(0, 0, 0)


def plain(rows, convs):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    out = []
    for conv in convs:
        given = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest(), digest(conv, *r[1:])))
        seen, faults = set(), []
        for _, role, text in given:
            marks = WHITE.findall(text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in given if t is not None}
        initials = [role[:1] for _, role, _ in given]
        cost, audit = cheapest(tuple(zip(initials, faults)))
        lines, kept, at = [], "", 0
        for letter in audit:
            role, text = (given[at][1:] if letter != "I" else ("", ""))
            at += letter != "I"
            if letter in "IR":
                role = "assistant" if kept.endswith("u") else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
                kept += role[:1]
        assert LEGAL.match(kept) and at == len(given)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def digest(conv, role, text):
    head = "-" if conv is None else f"={conv}"
    return hashlib.md5(f"{head}:{len(role)}:{role}{text}".encode()).digest()


def got(df):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_query_by_search(spark, small):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    assert got(queries.op13_repair(spark, small)) == plain(plain_damage(rows), {r[0] for r in rows})


def test_random_conversations_and_edges(spark, monkeypatch):
    rng = np.random.RandomState(4)
    roles, texts = ["system", "user", "assistant", "tool", None, ""], ["Yes.", "No", " ", "", None, "Why? ", "Ok!\n", "é…", "\xa0"]
    rows = [
        (int(c), int(t) if rng.rand() > 0.1 else None, roles[rng.choice(6, p=[0.1, 0.4, 0.35, 0.05, 0.05, 0.05])], texts[rng.choice(9, p=[0.3, 0.2, 0.1, 0.05, 0.05, 0.1, 0.1, 0.05, 0.05])])
        for c in range(150) for t in range(rng.randint(1, 9)) for _ in range(rng.choice([1, 1, 1, 2]))
    ]
    rows = [r if r[2] != "" else (*r[:2], "x", r[3]) for r in rows]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (900, 2**40, "user", "a."), (900, -(2**40), "assistant", "b.")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("cost", F.lit("x"))
    want = plain(plain_damage(rows), {r[0] for r in rows})
    marked = repair.damaged(turns)
    assert got(repair.repair(marked)) == want
    monkeypatch.setattr(repair, "SEGMENT", 3)  # conversations in several segments
    monkeypatch.setattr(repair, "BLOCK", 40)
    assert got(repair.repair(marked)) == want
    plans = repair.repair_plans(marked)
    turns_of = defaultdict(list)
    for r in sorted(repair.repaired_turns(marked, plans).collect(), key=lambda r: (str(r["conv_id"]), r["position"])):
        turns_of[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for row in want:
        assert hashlib.sha256("\n".join(turns_of[row[0]]).encode()).hexdigest() == row[-1]
    assert repair.repair(marked.limit(0)).count() == 0


def test_one_long_conversation(spark):
    n = 20_000
    rows = spark.range(n).selectExpr(
        "1L AS conv_id", "id AS turn", "element_at(array('user', 'assistant', 'user'), 1 + int(id % 3)) AS role",
        "CASE WHEN id % 7 = 0 THEN 'same.' ELSE concat('t', id, IF(id % 11 = 0, '', '.')) END AS text",
    )
    row = repair.repair(rows).collect()[0]
    kept = [("user", "assistant", "user")[k % 3][0] for k in range(n)]
    seen, faults = set(), []
    for k in range(n):
        text = "same." if k % 7 == 0 else f"t{k}" + ("" if k % 11 == 0 else ".")
        faults.append("duplicate" if (kept[k], text) in seen else "" if text.endswith(".") else "truncated")
        seen.add((kept[k], text))
    best = {0: (0, "")}  # forwards, whole strings
    for c, f in zip(kept, faults):
        best = {j: x for (_, j), x in repair.product({(0, i): x for i, x in best.items()}, repair.terminal("d" if f == "duplicate" else c.upper() if f else c)).items()}
    final = repair.product({(0, i): x for i, x in best.items()}, repair.INSERTS)
    cost, audit = min((final[0, s][0], repair.text_of(final[0, s][1])) for s in (0, 3) if (0, s) in final)
    assert (row["cost"], row["audit"], row["duplicate"]) == (cost, audit, faults.count("duplicate"))


def test_grammar_gives_what_plain_products_give():
    rng = np.random.RandomState(6)
    sequences = ["".join(rng.choice(list("dsuaxSUAX"), rng.randint(0, 200), p=[0.1, 0.05, 0.3, 0.3, 0.05, 0.02, 0.08, 0.08, 0.02])) for _ in range(40)]
    sequences += ["uuuuuuu", "u" * 500, "ua" * 300, "", "d"]
    rules, left = repair.re_pair(sequences)
    assert rules and sum(map(len, left)) < sum(map(len, sequences)) / 2

    def expand(k):
        return repair.SYMBOLS[k] if k < len(repair.SYMBOLS) else "".join(map(expand, rules[k - len(repair.SYMBOLS)]))

    assert ["".join(map(expand, s)) for s in left] == sequences
    for s, m in zip(sequences, repair.matrices(sequences)):
        fold = repair.Fold()
        fold.step(m)
        of = {"d": ("x", "blank")}
        assert fold.end() == cheapest(tuple(of.get(c, (c.lower(), "truncated" if c.isupper() else "")) for c in s))


def test_every_short_conversation():
    for n in range(5):
        for symbols in itertools.product("duaS", repeat=n):
            fold = repair.Fold()
            for c in symbols:
                fold.step(repair.terminal(c))
            assert fold.end() == cheapest(tuple(("x", "blank") if c == "d" else (c.lower(), "truncated" if c.isupper() else "") for c in symbols))
