"""Packing against the library's own encoding and against the bound on sequences."""

import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reachloom.llm import packing, queries

WORDS = ["Étion,", "don't", "I'LL", "<|endoftext|>x", "<|ENDOFTEXT|>B.", "a\x0bb", "x\x00y", "ΣΑΣ.", "J̌.", "é́", "İstanbul,", "A..", '"Qu?".', "12,", "½.", "…", "ab!", "漢字。", "w" * 200]


@functools.cache
def library(text):
    return encoder().encode([text or ""])[0]


@functools.cache
def encoder():
    return packing.WordIds("word_bpe_49k.json")


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_words_are_encoded_as_the_library_does(spark, small):
    made = packing.WordIds("word_bpe_49k.json")
    rng = np.random.RandomState(3)
    odd = [" ".join(rng.choice(WORDS, rng.randint(0, 30))) for _ in range(50)] + WORDS + ["", " ", "\n\t\r"]
    texts = odd + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for _ in range(2):  # new words, and remembered ones
        for t in texts:
            assert ids_of(made((t or "").encode())) == made.encode([t or ""])[0], t


def test_plain_words_go_to_the_model_itself():
    """Lower-case ASCII words need none of the library's rules before the model, which take most of its time."""
    made = packing.WordIds("word_bpe_49k.json")
    rng = np.random.RandomState(7)
    plain = ["".join(map(chr, rng.randint(97, 123, rng.randint(1, 14)))) for _ in range(3000)] + ["x" * 300, "s", "ll"]
    asked, encode = [], made.encode
    made.encode = lambda t: asked.extend(t) or encode(t)
    text = " ".join(plain + ["Upper", "mark."])
    got = ids_of(made(text.encode()))
    assert asked == ["."] and got == encode([text])[0]


def test_slices_and_small_word_tables(monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 40)
    monkeypatch.setattr(packing, "WORDS_HELD", 5)
    monkeypatch.setattr(packing, "CORES_HELD", 4)
    made = packing.WordIds("word_bpe_49k.json")
    text = " ".join(WORDS * 7)
    assert ids_of(made(text.encode())) == made.encode([text])[0]


def test_query_cuts_and_packs_every_document(spark, small):
    rows = queries.op11_packing(spark, small).collect()
    whole = {r["doc_id"]: [*library(r["text"]), 0] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = {(i, k // 2048, k, len(x[k : k + 2048]), zlib.crc32(np.array(x[k : k + 2048], "<u4").tobytes())) for i, x in whole.items() for k in range(0, len(x), 2048)}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    gapless(rows)
    least = -(-sum(map(len, whole.values())) // 2048)
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * least + 1


def gapless(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_edge_rows_and_long_texts(spark):
    long = "Wort, " * 6000
    rows = [(1, None, 7), (2, "", 7), (3, "one", 7), (3, "one", 7), (None, "two words", 7), (4, long, 7), (4, long, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    packed = packing.pack_documents(docs, with_ids=True)
    got = packed.collect()
    n = len(library(long)) + 1
    pieces = -(-n // 2048)
    assert Counter(r["doc_id"] for r in got) == {1: 1, 2: 1, 3: 2, None: 1, 4: 2 * pieces}
    assert {r["length"] for r in got if r["doc_id"] in (1, 2)} == {1} and all(r["ids"][-1] == 0 for r in got if r["doc_id"] == 3)
    gapless(got)
    joined = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in got:
        assert joined[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["small lengths", "hard halves", "one length", "alike thirds"])
def test_programs_place_every_piece(kind):
    rng = np.random.RandomState(5)
    counts = np.zeros(257, np.int64)
    if kind == "small lengths":
        counts[1:257] = rng.poisson(3, 256)
    elif kind == "hard halves":
        counts[100:190] = rng.randint(0, 5, 90)
    elif kind == "one length":
        counts[129] = 1000
    else:
        counts[[85, 86, 171, 256]] = [300, 7, 150, 11]
    rounded = packing.Program(counts).solve()
    got = np.zeros(257, np.int64)
    for found, number in rounded:
        assert number > 0 and sum(l * n for l, n in found.items()) <= 256
        for l, n in found.items():
            got[l] += n * number
    assert (got == counts).all()
    used, lengths = sum(n for _, n in rounded), np.arange(257)
    gaps = np.zeros(257, np.int64)  # best fit, decreasing
    plain = 0
    for l in np.repeat(lengths, counts)[::-1].tolist():
        fits = np.flatnonzero(gaps[l:])
        plain += not len(fits)
        gap = fits[0] + l if len(fits) else 256
        gaps[gap] -= bool(len(fits))
        gaps[gap - l] += 1
    assert used <= max(-(-int(counts @ lengths) // 256) + 1, plain + plain // 200 + 1)


def test_places_cover_each_number_once():
    rounded = [({5: 2, 3: 1}, 4), ({3: 3}, 2), ({5: 1}, 1)]
    length, first, sequence, offset = packing.places(rounded)
    assert [(a, b) for a, b in zip(length, first)] == [(3, 0), (3, 4), (3, 6), (3, 8), (5, 0), (5, 4), (5, 8)]
    assert sequence.tolist() == [0, 4, 4, 4, 0, 0, 6] and offset.tolist() == [10, 0, 3, 6, 0, 5, 0]


def odd_words():
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    rng = np.random.RandomState(11)
    pool = [*letters, *"etaoin" * 40, *marks, *"0123456789", "'s", "<|endoftext|>", "́", "漢", "×", "…", "\x00", "\x1c", " "]
    return ["".join(rng.choice(pool, rng.randint(1, 9))) for _ in range(4000)] + ["x" + c for c in letters] + [c + "E!1" for c in letters]


def test_units_of_words_are_what_the_rules_make():
    """Every letter up to U+024F, marks, digits and what the rules do more to: alone and together, as the library has it."""
    made = packing.WordIds("word_bpe_49k.json")
    words = odd_words()
    assert made.parted("Étoile,***12".encode()) == ("étoile".encode(), b",***", b"1", b"2")
    for w, ids in zip(words, made.encode(words), strict=True):
        assert ids_of(made(w.encode())) == ids, w


def test_slices_share_texts_and_nulls(monkeypatch):
    """Rows in one slice, cut texts between them, nulls and a sliced column: each row gets its own ids and its own count."""
    rng = np.random.RandomState(13)
    texts = [" ".join(rng.choice(WORDS, rng.randint(0, 40))) for _ in range(60)]
    texts[7:9], texts[0], texts[-1] = [None, ""], None, "  a  "
    for size in (4 << 20, 100, 1):
        monkeypatch.setattr(packing, "SLICE_BYTES", size)
        for kind in (pa.binary(), pa.large_binary()):
            column = pa.array([None if t is None else t.encode() for t in ["before", *texts]], kind).slice(1)
            want = [library(t) for t in texts]
            assert [ids_of(x) for x in packing.WordIds("word_bpe_49k.json").every(column)] == want
            assert packing.WordCounts("word_bpe_49k.json").counts(column).tolist() == [len(x) for x in want]


def test_words_that_are_not_utf8():
    made = packing.WordIds("word_bpe_49k.json")
    assert ids_of(made(b"a\xff b\xc3, ok")) == made.encode(["a� b�, ok"])[0]


def test_a_word_is_looked_up_once_a_slice():
    """Before, each text's words were looked up one by one: most of the time went into that."""
    made, asked = packing.WordIds("word_bpe_49k.json"), []
    values = made.values
    made.values = lambda words: asked.append(len(words)) or values(words)
    assert len(list(made.every(pa.array([b"one two one", b"two one"] * 500, pa.binary())))) == 1000
    assert asked == [2]
