"""Quality classifier (2): supervised subword embeddings.

A document is the average of learned vectors, one for each of its words and of
their character n-grams, hashed into BUCKETS rows, and one more for each word
that repeats the word before it; a linear layer and a softmax over the two labels
follow.  The layer's bias is the log share of the labels, so a text that shows
nothing known gets that share.  Vectors and layer are trained together by
stochastic gradient descent in numpy, on a sample of at most ``max_rows``
labelled documents (those with the smallest hash of their id), whole texts.

Training is small and bounded; scoring is a pass over all documents.  As the
layer is linear, a word's share of the two outputs is a fixed number, which a
worker computes once per distinct word.

Words are runs without ASCII white space, as they are written: case and signs
around a word tell much about quality.  Words of any length have n-grams, over
characters; those of long words are hashed by array code, piece by piece.  Null and empty texts have no features and get
the score of the layer's bias alone.  Labels of null documents or of null
quality are ignored; a document with several labels takes the largest.  Without
any label every score is 0.5.  Repeated rows are scored each; an empty table
gives no rows; extra columns are ignored or, in the filter, kept.
"""
from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import CACHE_WORDS, append, bounded_sample, free_name

#: Rows of the hashed table, components of a vector, lengths of character n-grams.
BUCKETS, DIMS, GRAMS = 1 << 16, 16, (3, 4)
#: Row of a word that repeats the one before it, behind the hashed rows.
AGAIN = BUCKETS
#: Words of more bytes than this are hashed by array code, PIECE characters at a time, and never cached.
LONG_WORD, PIECE = 64, 1 << 16


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


CRC_TABLE = _crc_table()


def _whole(word: bytes) -> bytes:
    """The word as sound UTF-8."""
    return word if word.isascii() else word.decode("utf-8", "replace").encode()


def features_of(word: bytes) -> list[int]:
    """Rows of a word and of its character n-grams, marked at both ends (CRC-32 of their UTF-8)."""
    marked = b"<" + _whole(word) + b">"
    starts = range(len(marked) + 1) if word.isascii() else [*(i for i, b in enumerate(marked) if b & 0xC0 != 0x80), len(marked)]
    rows = [zlib.crc32(b"w" + word) % BUCKETS]
    for n in GRAMS:
        rows += [zlib.crc32(marked[a:b]) % BUCKETS for a, b in zip(starts, starts[n:])]
    return rows


def features_of_long(word: bytes, piece: int = PIECE):
    """The same rows as arrays, for the n-grams that begin in PIECE characters each."""
    raw = np.frombuffer(b"<" + _whole(word) + b">", np.uint8)
    yield np.array([zlib.crc32(b"w" + word) % BUCKETS])
    at, longest = 0, 4 * (piece + max(GRAMS))
    while at < len(raw):
        part = raw[at:at + longest]
        starts = np.flatnonzero((part & 0xC0) != 0x80)
        if at + longest >= len(raw):
            starts = np.append(starts, len(part))
        for n in GRAMS:
            first = starts[:-n][:piece]
            end = starts[n:][:piece]
            crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
            for k in range(int((end - first).max(initial=0))):
                on = np.flatnonzero(first + k < end)
                crc[on] = CRC_TABLE[(crc[on] ^ part[first[on] + k]) & np.uint32(0xFF)] ^ (crc[on] >> np.uint32(8))
            yield (~crc % np.uint32(BUCKETS)).astype(np.int64)
        at = at + int(starts[piece]) if len(starts) > piece else len(raw)


def repeats(words: list[bytes]) -> int:
    """Words equal to the word before them."""
    return sum(map(eq, words, words[1:]))


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights) of a text; the weights sum to 1."""
    words, counts = text.split(), Counter()
    for word, n in Counter(words).items():
        if len(word) <= LONG_WORD:
            for row in features_of(word):
                counts[row] += n
            continue
        for part in features_of_long(word):
            for row, k in zip(*(x.tolist() for x in np.unique(part, return_counts=True))):
                counts[row] += n * k
    counts[AGAIN] += repeats(words)
    counts += Counter()  # drops a zero
    rows = np.fromiter(counts.keys(), np.int64, len(counts))
    weights = np.fromiter(counts.values(), np.float64, len(counts))
    return rows, weights / weights.sum() if len(counts) else weights


@dataclass
class Model:
    """What scoring needs: per row, the difference of the two outputs that its vector makes; the bias's difference."""
    rows: np.ndarray
    bias: float


def train(examples: list[tuple[bytes, int]], epochs: int = 6, rate: float = 0.5, seed: int = 11) -> Model:
    """Stochastic gradient descent over (text, label), one document a step, with a falling rate."""
    if not examples:
        return Model(np.zeros(BUCKETS + 1, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS + 1, DIMS))
    layer = rng.uniform(-1 / DIMS, 1 / DIMS, (2, DIMS))
    bags, labels = [bag(t) for t, _ in examples], [y for _, y in examples]
    bias = np.log((np.bincount(labels, minlength=2) + 1) / (len(labels) + 2))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            rows, weights = bags[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = weights @ vectors[rows] if len(rows) else np.zeros(DIMS)
            out = layer @ mean + bias
            out = np.exp(out - out.max())
            error = out / out.sum()
            error[labels[i]] -= 1
            back = layer.T @ error
            layer -= step * np.outer(error, mean)
            if len(rows):
                # a row's gradient is its weight; divided by the largest weight so that long texts teach as much as short ones
                vectors[rows] -= np.outer(step * weights / weights.max(), back)
    difference = layer[1] - layer[0]
    return Model((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]))


class WordShares(dict):
    """word -> (sum of its rows' differences, number of rows); emptied at CACHE_WORDS, long words are not kept."""

    def __init__(self, model: Model):
        super().__init__()
        self.values_of = model.rows

    def __missing__(self, word: bytes) -> complex:
        if len(word) > LONG_WORD:
            return sum((complex(float(self.values_of[part].sum(dtype=np.float64)), len(part)) for part in features_of_long(word)), 0j)
        if len(self) >= CACHE_WORDS:
            self.clear()
        rows = features_of(word)
        share = self[word] = complex(float(self.values_of[rows].sum(dtype=np.float64)), len(rows))
        return share


def margin(words: list[bytes], shares, model: Model) -> float:
    """Difference of the two outputs for a text's words."""
    again = repeats(words)
    total = sum(map(shares, words), complex(float(model.rows[AGAIN]) * again, again))
    return (total.real / total.imag if total.imag else 0.0) + model.bias


def held_out(doc_id):
    """Rows never learned from: crc32(doc_id as text) mod 5 = 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2000, max_bytes: int = 128 << 20) -> Model:
    """The model of at most max_rows labelled documents (smallest hashes of the id) of at most max_bytes of text in all.

    A document stands once however many rows repeat its id.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the broadcast side has max_rows rows of two numbers at most
    rows = bounded_sample(texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality"), "doc_id", max_bytes)
    return train([(r.text.encode(), r.quality) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))])


SCORE = "__score"


def score(docs: DataFrame, model: Model, out: str = SCORE) -> DataFrame:
    """docs with the column ``out``: the softmax output of label 1."""

    def start():
        import pyarrow as pa
        shares = WordShares(model).__getitem__

        def run(data, part):
            out = np.zeros(len(data))
            for i, text in enumerate(data):
                out[i] = margin(text.split(), shares, model)
            return [pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))))]
        return run

    return append(docs, start, [(out, "double")])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col(SCORE).alias("score"),
        (F.col(SCORE) >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    out = free_name(docs, SCORE)
    return score(docs, fit(docs, labels), out).filter(F.col(out) >= threshold).drop(out)
