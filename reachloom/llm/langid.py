"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (n = 1..ORDER, lower-cased) that both have, whatever their
number in each (blended-spectrum presence kernel), normalised to 1 for equal texts. N-grams are hashed into 2^BITS
presence flags. Landmark texts give a Nyström map, and one ridge regression per language against all others is fitted
in that space. Kernels with the landmarks are linear in a text's presence flags, so landmarks, whitening and
regression fold into one matrix, and a batch of texts is scored by one matrix product.

The fit uses a bounded sample: at most `per_language` training rows of each language, the first by a hash of id, text
and language (the bound is a parameter), of which `landmarks` rows are landmarks. Workers turn each into 2^BITS flags,
so that the driver gets (2^BITS / 8) bytes a row. Predictions cover every whole text.

Cases: a null text, or one without a letter, is `und` with score 0. Rows with a null language are never learnt from.
Without training rows everything is `und`. Equal scores go to the language that sorts first. Repeated rows each get
their row; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import annotate

ORDER = 4
BITS = 17


def gram_flags(text: str) -> np.ndarray:
    """Indices of the flags that a text sets: hashes of its distinct n-grams."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    flags = np.zeros(1 << BITS, bool)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, ORDER + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
        flags[((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(flags)


@dataclass
class Model:
    languages: list[str]
    used: np.ndarray  # flag -> row of weights, or -1
    weights: np.ndarray  # rows x languages
    bias: np.ndarray


def fit(rows: list[np.ndarray], langs: list[str], landmarks: int, ridge: float) -> Model:
    """Nyström features of the sample's kernel with the landmarks, then ridge regression for each language."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.empty(0), np.empty(0), np.empty(0))
    by_turn = sorted(range(len(rows)), key=lambda i: (sum(1 for j in range(i) if langs[j] == langs[i]), langs[i]))
    marks = by_turn[: min(landmarks, len(rows))]  # languages take turns
    vocabulary = np.unique(np.concatenate([rows[i] for i in marks]))
    used = np.full(1 << BITS, -1, np.int64)
    used[vocabulary] = np.arange(len(vocabulary))

    def flat(i: int) -> np.ndarray:
        x = np.zeros(len(vocabulary), np.float32)
        at = used[rows[i]]
        x[at[at >= 0]] = 1 / np.sqrt(max(len(rows[i]), 1))
        return x

    marked = np.stack([flat(i) for i in marks])
    kernel = (marked @ marked.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate(
        [np.stack([flat(i) for i in range(a, min(a + 256, len(rows)))]) @ marked.T @ whiten for a in range(0, len(rows), 256)]
    )
    targets = np.array([[1.0 if g == x else -1.0 for x in languages] for g in langs])
    bias = targets.mean(0)
    gram = features.T @ features + ridge * len(rows) / len(marks) * np.eye(features.shape[1])
    alpha = np.linalg.solve(gram, features.T @ (targets - bias))
    return Model(languages, used, (marked.T @ (whiten @ alpha)).astype(np.float32), bias)


def train(
    docs: DataFrame, chosen: Column, text: str = "text", lang: str = "lang", id_column: str = "doc_id",
    per_language: int = 250, landmarks: int = 256, ridge: float = 0.01,
) -> Model:
    """A model from the rows where `chosen` holds and the language isn't null."""
    rows = docs.where(chosen & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(id_column), F.col(lang), F.col(text)).alias("key"),
    )
    first = rows.select("lang", "key").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
    first = first.where(F.col("n") <= per_language).select("lang", "key")
    sample = rows.join(F.broadcast(first.distinct()), ["lang", "key"])  # at most per_language rows a language

    def start():
        def work(values: list) -> dict[str, list]:
            return {"flags": [np.packbits(np.isin(np.arange(1 << BITS), gram_flags(v.decode("utf-8", "replace")))).tobytes() for v in values]}

        return work

    got = annotate(sample, start, [("flags", "binary")], "text", ["lang", "key"]).orderBy("lang", "key").collect()
    taken: dict[str, int] = {}
    kept = []
    for r in got:  # equal rows share a key
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_language:
            kept.append(r)
    flags = [np.flatnonzero(np.unpackbits(np.frombuffer(r["flags"], np.uint8))) for r in kept]
    return fit(flags, [r["lang"] for r in kept], landmarks, ridge)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score: the winner's share after a softmax of the languages' regressions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def work(values: list) -> dict[str, list]:
            names, scores = ["und"] * len(values), [0.0] * len(values)
            if not m.languages:
                return {"lang_pred": names, "score": scores}
            for a in range(0, len(values), 64):
                decoded = [(k, v.decode("utf-8", "replace")) for k, v in enumerate(values[a : a + 64], a) if v]
                rows = [(k, gram_flags(t)) for k, t in decoded if any(map(str.isalpha, t))]
                if not rows:
                    continue
                x = np.zeros((len(rows), len(m.weights)), np.float32)
                for j, (_, flags) in enumerate(rows):
                    at = m.used[flags]
                    x[j, at[at >= 0]] = 1 / np.sqrt(len(flags))
                y = x @ m.weights + m.bias
                share = np.exp(4 * (y - y.max(1, keepdims=True)))
                share /= share.sum(1, keepdims=True)
                for (k, _), best, s in zip(rows, y.argmax(1), share, strict=True):
                    names[k], scores[k] = m.languages[best], float(s[best])
            return {"lang_pred": names, "score": scores}

        return work

    return annotate(docs, start, [("lang_pred", "string"), ("score", "double")], text, keep)
