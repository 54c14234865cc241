"""Substring dedup (10): Rabin-Karp hashes of every window of words, counted in Spark.

1. Every window of ``window`` words gets a 64-bit polynomial hash, and so does
   every run of ANCHOR_WORDS words inside it.  A window's anchor is the smallest
   hash of such a run; equal windows have equal anchors, and neighbours mostly
   share theirs, so anchors are few.
2. Anchors are counted over documents.  A window whose anchor occurs in no other
   document cannot repeat and needs no row of its own.
3. The remaining windows' hashes are counted in Spark: the smallest doc_id of
   each.  Windows whose hash has a smaller doc_id than their own are removed;
   they merge into maximal intervals of words.

Words: ``[^\\x20\\x09-\\x0D]+``, unchanged.  Null texts have no words.  Rows with
a null doc_id have no smaller document and are none, so they keep every word.
Rows that repeat a doc_id are one document: they never remove each other.  Texts
of fewer words than a window stay whole; an empty table gives no rows; extra
columns are ignored.  Two different windows are taken for equal only if their
64-bit hashes and their anchors' hashes collide.
"""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import append, mixed, word_hashes, worker_cache, written

WINDOW, ANCHOR_WORDS = 50, 8
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the worker's later texts."""
    known = worker_cache("powers").setdefault(base, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    worker_cache("powers")[base] = known
    return known[:n]


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every run of n words: (sum of word * base^position) / base^start, modulo 2^64."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(BASE, len(hashes)), dtype=np.uint64)])
    return mixed((sums[n:] - sums[:-n]) * _powers(BASE_INVERSE, len(hashes) - n + 1))


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours, by doubling."""
    span = 1
    while 2 * span <= n:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[:len(values) - (n - span)], values[n - span:]) if n > span else values


def windows_of(data: list[bytes], window: int) -> list[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(words, window hashes, window anchors) of each text; one pass of arithmetic over all of them."""
    words = [t.split() for t in data]
    sizes = [len(w) for w in words]
    hashes = word_hashes([x for w in words for x in w])
    whole = rolling(hashes, window)
    anchors = sliding_min(rolling(hashes, ANCHOR_WORDS), window - ANCHOR_WORDS + 1) if len(whole) else whole
    out, at = [], 0
    for w, n in zip(words, sizes):
        k = max(0, n - window + 1)
        out.append((w, whole[at:at + k], anchors[at:at + k]))
        at += n
    return out


def _survey(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, n_words, sha256 of all words, distinct anchors) of each row."""

    def start():
        import pyarrow as pa

        def run(data, part):
            n_words, digests, anchors = [], [], []
            for words, _, marks in windows_of(data, window):
                n_words.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                anchors.append(np.unique(marks).view(np.int64))
            return [pa.array(n_words, pa.int64()), pa.array(digests, pa.string()), pa.array(anchors, pa.list_(pa.int64()))]
        return run

    return append(docs, start, [("n_words", "bigint"), ("digest", "string"), ("anchors", "array<bigint>")]).drop("text")


def _candidates(docs: DataFrame, window: int) -> DataFrame:
    """docs (with shared anchors) plus starts and hashes of the windows that have one of these anchors."""

    def start():
        import pyarrow as pa

        def run(data, part):
            starts, hashes = [], []
            for (_, whole, marks), shared in zip(windows_of(data, window), part.column("shared").to_pylist()):
                at = np.flatnonzero(np.isin(marks, np.array(shared, np.int64).view(np.uint64)))
                starts.append(at.astype(np.int32))
                hashes.append(whole[at].view(np.int64))
            return [pa.array(starts, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))]
        return run

    return append(docs, start, [("starts", "array<int>"), ("hashes", "array<bigint>")]).drop("shared")


def _kept(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """docs (with starts of removed windows): what is left of them, as a digest and, if asked for, as text."""

    def start():
        import pyarrow as pa

        def run(data, part):
            removed, kept, digests, spans = [], [], [], []
            for text, starts in zip(data, part.column("removed").to_pylist()):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, np.array(starts), 1)
                np.add.at(edge, np.array(starts) + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                removed.append(int(gone.sum()))
                kept.append(left.decode("utf-8", "replace") if with_text else None)
                digests.append(hashlib.sha256(left).hexdigest())
                spans.append([{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)])
            return [pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        return run

    fields = [("n_removed", "bigint"), ("kept_sha256", "string"), ("kept", "string"),
              ("intervals", "array<struct<start:int,end:int>>")]
    return append(docs, start, fields).drop("text", "removed", *([] if with_text else ["kept"]))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, intervals) of each row; with_text adds the changed rows' kept text."""
    if window <= ANCHOR_WORDS:
        raise ValueError(f"windows need more than {ANCHOR_WORDS} words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    key = ["doc_id", "text_hash"]
    survey = written(_survey(rows, window))
    marks = survey.filter("doc_id IS NOT NULL").select(*key, F.explode("anchors").alias("anchor"))
    shared = written(marks.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                     .filter("first < last").select("anchor"))
    per_doc = written(marks.join(shared, "anchor")).groupBy(*key).agg(F.collect_set("anchor").alias("shared"))
    some = written(_candidates(rows.join(per_doc, key), window))
    found = some.select(*key, F.explode(F.arrays_zip("starts", "hashes")).alias("w")) \
        .select(*key, F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash"))
    first = written(found.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                    .filter("first < last").select("hash", "first"))
    gone = (found.join(first, "hash").filter("doc_id > first").select(*key, "start").distinct()
            .groupBy(*key).agg(F.collect_list("start").alias("removed")))
    # rows that repeat a document repeat its result: they are made one after the text is gone
    changed = written(_kept(some.select(*key, "text").join(gone, key), window, with_text).dropDuplicates(key))
    out = survey.join(changed, key, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
        F.coalesce("intervals", F.array().cast("array<struct<start:int,end:int>>")).alias("intervals"),
        *(["kept"] if with_text else []))
    return out
