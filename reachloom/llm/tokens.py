"""Token counts with a public tokenizer, returning lengths only.

The library encodes batches of texts, balanced by bytes: the largest first, into as few batches of about BATCH_BYTES as
hold them. Only the lengths of the encodings are kept. What it encodes depends on the tokenizer:

* word_bpe_49k.json never joins text across ASCII white space (white space is dropped between words, composition and
  lower-casing stop at it, and the special strings have none): a text's count is the sum over its words. The distinct
  words of a slice of texts that weren't seen before are encoded, and a worker remembers the counts of WORDS_HELD words
  in each of two generations (packing.WordCounts).
* Others whose rules are alike (cut=True) get whole texts, those longer than LONG_BYTES in pieces of about that size,
  split at safe boundaries, runs of ASCII spaces, tabs and line ends.
* Tokenizers without this property are given whole texts (cut=False).

Cases: null counts as empty, and empty texts have no tokens. A stretch without white space is never cut, however long.
Repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing
from .common import SLICE_ROWS, annotate

BATCH_BYTES = 256 << 10
LONG_BYTES = 64 << 10
#: Words whose counts a generation of a worker's table holds.
WORDS_HELD = 500_000
#: Tokenizers whose rules packing.WordIds knows.
BY_WORD = {"word_bpe_49k.json"}
SAFE = re.compile(r"[ \t\n\r]+")


class Counting:
    """Token counts of texts by one tokenizer file (.json: tokenizers, .model: sentencepiece)."""

    def __init__(self, name: str, cut: bool):
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = public_tokenizers.path(name)
        self.cut = cut
        self.words = packing.WordCounts(name, WORDS_HELD) if cut and name in BY_WORD else None
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda t: [len(e) for e in tokenizer.encode_batch_fast(t, add_special_tokens=False)]
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda t: [len(e) for e in pieces.encode(t, num_threads=1)]

    def pieces(self, text: str, size: int = LONG_BYTES) -> list[str]:
        """A text, or what it is split into where it is long: each piece ends at the first safe boundary after `size`."""
        if not self.cut or len(text) <= size:
            return [text]
        out, at = [], 0
        while at < len(text):
            found = SAFE.search(text, at + size)
            end = found.start() if found else len(text)
            out.append(text[at:end])
            at = found.end() if found else end
        return out

    def lengths(self, texts: list[str]) -> list[int]:
        if self.words:
            return self.words.counts(pa.array([t.encode() for t in texts], pa.binary())).tolist()
        counts = [0] * len(texts)
        pieces = [(k, p) for k, t in enumerate(texts) if t for p in self.pieces(t)]
        for batch in packing.batches([len(p) for _, p in pieces], BATCH_BYTES):
            for j, n in zip(batch, self.encode([pieces[j][1] for j in batch]), strict=True):
                counts[pieces[j][0]] += n
        return counts

    def counts(self, texts: pa.Array) -> np.ndarray | list[int]:
        """The number of tokens of each text (binary; null: empty)."""
        if self.words:
            return self.words.counts(texts)
        out: list[int] = []
        for at in range(0, len(texts), SLICE_ROWS):  # few texts are held as objects at once
            out += self.lengths([(v or b"").decode("utf-8", "replace") for v in texts.slice(at, SLICE_ROWS).to_pylist()])
        return out


#: One for each tokenizer in a Python worker, kept between its tasks.
_loaded: dict[tuple[str, bool], Counting] = {}


def token_counts(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    limit: int = 2048,
    text: str = "text",
    keep: list[str] | None = None,
    cut: bool = True,
) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text."""

    def start():
        count = _loaded.setdefault((tokenizer, cut), None) or Counting(tokenizer, cut)
        _loaded[(tokenizer, cut)] = count

        def work(texts: pa.Array) -> dict:
            return {"n_bytes": pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), "n_tokens": count.counts(texts)}

        return work

    kept = [c for c in (docs.columns if keep is None else keep) if c != "over_limit"]
    counted = annotate(docs, start, [("n_bytes", "bigint"), ("n_tokens", "bigint")], text, kept, whole=True)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
