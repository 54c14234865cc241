"""Periodic runs (13): every maximal repetition of words, by difference-cover longest common extensions.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and at least max(MIN_LENGTH, 2 q) words that no neighbouring
word extends.  Texts of a block are numbered word by word and joined into one
array with a separator of its own at every end, so nothing reaches across.

1. Grid: a run of period q has at least ``step = max(q, MIN_LENGTH - q)``
   neighbouring positions i with word i = word i + q, so one of them is a
   multiple of the step: only these harmonic grids are looked at, n / step
   positions for each period.  The positions stretch at least half a step to
   one side, so three equal neighbours on one side are asked for.
2. Extension: a candidate is extended to both sides by longest common
   extensions.  Positions whose remainder modulo COVER_PERIOD lies in COVER are
   the only sorted suffixes; any two positions reach a sampled pair after the
   same number of words, below COVER_PERIOD.  These few words are compared, the
   rest is a range minimum over the neighbours' common prefixes (sparse table).
   The reversed array answers extensions to the left.
3. Every period that divides into a run finds the same stretch; the smallest is kept.

Words: ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have no words and no run.
Every row is judged alone: repeated, null and tied ids give a row each.  Very
long texts are blocks of their own, whole; memory is about 150 bytes a word.
Extra columns are ignored whatever their names; an empty table gives no rows.
"""
from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import blocks, texts

MIN_LENGTH = 12
#: Every difference modulo COVER_PERIOD is a difference of two members of COVER.
COVER_PERIOD, COVER = 13, (0, 1, 3, 9)
#: Candidates that are extended at a time.
CANDIDATES = 1 << 18


def _shifts() -> np.ndarray:
    """[i mod v, j mod v] -> the smallest number of words after which both positions are sampled."""
    inside = np.isin(np.arange(COVER_PERIOD), COVER)
    i, j, d = np.ogrid[:COVER_PERIOD, :COVER_PERIOD, :COVER_PERIOD]
    return np.argmax(inside[(i + d) % COVER_PERIOD] & inside[(j + d) % COVER_PERIOD], axis=2)


def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rank of every entry, equal ones alike: order sorts them, new marks where the next differs from the one before."""
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks


class CommonExtensions:
    """Longest common extensions to the right in an array of word numbers whose last entry occurs once."""

    def __init__(self, words: np.ndarray):
        v, n = COVER_PERIOD, len(words)
        top = int(words.max()) + 1
        self.words = np.concatenate([words, np.arange(top, top + 2 * v)])  # no two of the added entries are equal
        self.shift = _shifts()
        at = np.flatnonzero(np.isin(np.arange(n) % v, COVER))
        self.index = np.zeros(n, np.int64)  # position -> number of the sampled suffix
        self.index[at] = np.arange(len(at))
        levels = self._sort(at, top + 2 * v)
        self.rank, order = levels[-1], np.argsort(levels[-1])
        self._table(at[order], levels)

    def _sort(self, at: np.ndarray, top: int) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first v, 2 v, 4 v ... words, until no two are equal."""
        v = COVER_PERIOD
        each = 62 // top.bit_length()
        keys = []
        for first in range(0, v, each):  # several word numbers make one key
            key = np.zeros(len(at), np.int64)
            for k in range(first, min(first + each, v)):
                key = (key << top.bit_length()) | self.words[at + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.ones(len(at), bool)
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
        levels, length = [_ranks(order, new)], v
        while levels[-1].max(initial=-1) + 1 < len(at):
            rank, there = levels[-1], at + length
            # a suffix that ends before is alone in its rank, whatever follows
            follow = np.where(there < len(self.index), rank[self.index[np.minimum(there, len(self.index) - 1)]], 0)
            key = rank * (len(at) + 1) + follow
            order = np.argsort(key, kind="stable")
            new[1:] = key[order[1:]] != key[order[:-1]]
            levels.append(_ranks(order, new))
            length *= 2
        return levels

    def _table(self, sorted_at: np.ndarray, levels: list[np.ndarray]) -> None:
        """Sparse table of minima over the common prefixes of neighbouring sampled suffixes."""
        a, b = sorted_at[:-1].copy(), sorted_at[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 2, -1, -1):  # no two are equal at the last level
            step = np.where(levels[k][self.index[a]] == levels[k][self.index[b]], COVER_PERIOD << k, 0)
            a, b, common = a + step, b + step, common + step
        alive = np.ones(len(a), bool)
        for k in range(COVER_PERIOD):
            alive &= self.words[a + k] == self.words[b + k]
            common += alive
        self.minima, span = [common.astype(np.int32)], 1
        while 2 * span <= len(common):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that agree from i and j (i != j) on."""
        far = self.shift[i % COVER_PERIOD, j % COVER_PERIOD]
        out = np.zeros(len(i), np.int64)
        active = np.arange(len(i))
        for k in range(COVER_PERIOD):
            reached = far[active] == k
            synced = active[reached]
            if len(synced):
                out[synced] = k + self._sampled(i[synced] + k, j[synced] + k)
            active = active[~reached]
            active = active[self.words[i[active] + k] == self.words[j[active] + k]]
            out[active] = k + 1
            if not len(active):
                break
        return out

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[self.index[i]], self.rank[self.index[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.minima[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out


def _grid(words: np.ndarray, longest: int):
    """(position, period) arrays of equal words one period apart, position on the period's grid."""
    n = len(words)
    few = min(longest, max(MIN_LENGTH, int(n ** 0.5)))
    for q in range(1, few + 1):  # short periods: one after another, all their positions
        step = max(q, MIN_LENGTH - q)
        i = np.flatnonzero(words[:n - q:step] == words[q::step][:len(words[:n - q:step])]) * step
        yield i, np.full(len(i), q)
    for k in range(1, (n - 1) // (few + 1)):  # long ones: the k-th position of all of them
        last = min(longest, (n - 1) // (k + 1))
        q = np.arange(few + 1, last + 1)
        if len(q):
            hit = words[k * (few + 1):k * last + 1:k] == words[(k + 1) * (few + 1):(k + 1) * last + 1:k + 1]
            yield k * q[hit], q[hit]


def _likely(words: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether three neighbours on one side agree, too; words has four entries of padding on each side."""
    def side(sign):
        on = words[i + 4 + sign] == words[i + 4 + sign + q]
        for k in (2, 3):
            on &= words[i + 4 + sign * k] == words[i + 4 + sign * k + q]
        return on
    return side(1) | side(-1)


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    """(start, end, period) rows sorted, one for every stretch: its smallest period."""
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def _joined(texts_: list[np.ndarray], separator: int) -> tuple[np.ndarray, np.ndarray]:
    """(one array with an entry of its own before, between and behind the texts, start of every text)."""
    sizes = np.array([len(t) for t in texts_], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    words = np.empty(int(sizes.sum()) + len(texts_) + 1, np.int64)
    for start, t in zip(starts.tolist(), texts_):
        words[start - 1], words[start:start + len(t)] = separator, t
        separator += 1
    words[-1] = separator
    return words, starts


def _extended(texts_: list[np.ndarray], starts: np.ndarray, separator: int, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(start, end, period) of the runs that the candidates lie in; suffixes are sorted for the texts that have any."""
    text = np.searchsorted(starts, i, side="right") - 1
    inside = text == np.searchsorted(starts, i + q, side="right") - 1
    i, q, text = i[inside], q[inside], text[inside]
    if not len(i):
        return np.zeros((0, 3), np.int64)
    members, text = np.unique(text, return_inverse=True)
    words, at = _joined([texts_[k] for k in members.tolist()], separator)
    moved = starts[members] - at
    i = i - moved[text]
    n = len(words)
    right, left = CommonExtensions(words), CommonExtensions(words[::-1])
    start, end = i - left(n - i, n - i - q), i + q + right(i, i + q)
    keep = end - start >= np.maximum(MIN_LENGTH, 2 * q)
    rows = np.stack([start[keep] + moved[text[keep]], end[keep] + moved[text[keep]], q[keep]], axis=1)
    return _distinct([rows])


def runs_of_coded(texts_: list[np.ndarray], separator: int) -> list[np.ndarray]:
    """Per text of word numbers below separator its runs: (start, length, period) rows sorted by start and period."""
    words, starts = _joined(texts_, separator)
    narrow = words.astype(np.int32)
    edge = separator + len(texts_) + 1
    padded = np.concatenate([np.arange(edge, edge + 4, dtype=np.int32), narrow, np.arange(edge + 4, edge + 8, dtype=np.int32)])
    found, waiting, n_waiting = [], [], 0
    for i, q in _grid(narrow, max(map(len, texts_)) // 2):
        if len(i):
            keep = _likely(padded, i, q)
            if keep.any():
                waiting.append((i[keep], q[keep]))
                n_waiting += len(waiting[-1][0])
                if n_waiting >= CANDIDATES:
                    found = [_distinct([*found, _extended(texts_, starts, separator, *map(np.concatenate, zip(*waiting)))])]
                    waiting, n_waiting = [], 0
    if waiting:
        found.append(_extended(texts_, starts, separator, *map(np.concatenate, zip(*waiting))))
    rows = _distinct(found)
    ends = np.searchsorted(rows[:, 0], [*starts.tolist(), len(words)])
    out = []
    for start, a, b in zip(starts.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
        part = rows[a:b]
        part = np.stack([part[:, 0] - start, part[:, 1] - part[:, 0], part[:, 2]], axis=1)
        out.append(part[np.lexsort((part[:, 2], part[:, 0]))])
    return out


def runs_of_texts(words: list[list[bytes]]) -> list[np.ndarray]:
    """For every list of words its runs: (start, length, period) rows sorted by start and period."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    out = [np.zeros((0, 3), np.int64)] * len(words)
    groups = defaultdict(list)  # texts of like lengths share an array, so that few periods are tried beyond a text's own
    for k, w in enumerate(words):
        if len(w) >= MIN_LENGTH:
            groups[len(w).bit_length()].append((k, np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))))
    for members in groups.values():
        for (k, _), rows in zip(members, runs_of_coded([coded for _, coded in members], len(numbers))):
            out[k] = rows
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside of runs and every run's first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _run_rows(batches):
    import pyarrow as pa
    for ids, data in blocks(batches):
        words = [t.split() for t in data]
        runs = runs_of_texts(words)
        flat = np.concatenate(runs)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        yield pa.RecordBatch.from_arrays([
            pa.array([i[0] for i in ids], pa.string()), pa.array([len(w) for w in words], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
            pa.array([collapsed(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())],
            ["id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs array<struct<start, length, period>> by start and period, collapsed text) per row."""
    kind = docs.schema[key].dataType
    rows = texts(docs.withColumn(key, F.col(key).cast("string")), key, text=text).mapInArrow(
        _run_rows, "id string, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return rows.select(F.col("id").cast(kind).alias(key), "n_words", "runs", "collapsed")


def tiled_tails(docs: DataFrame) -> DataFrame:
    """The contract's planted runs: in every tenth document (by crc32 of its id) the words from one on repeat with a period.

    DataFrame functions only; the other texts stay as they are, and so do
    those without words and rows without an id.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    planted = F.coalesce(h % 10 == 0, F.lit(False))
    df = docs.select("doc_id", "text", F.when(planted, g).alias("__g"),
                     F.when(planted, F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).alias("__words"))
    n = F.size("__words")
    df = df.withColumn("__n", n).withColumn("__a", F.when(n > 0, F.pmod(F.col("__g"), n)).cast("int"))
    left = F.col("__n") - F.col("__a")
    df = df.withColumn("__p", (1 + F.floor(left / (3 + F.col("__g") % 8))).cast("int"))
    tail = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    tail = F.slice(F.flatten(F.array_repeat(tail, F.ceil(left / F.col("__p")).cast("int"))), F.lit(1), left)
    tiled = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), tail), " ")
    return df.select("doc_id", F.when(F.col("__p").isNotNull(), tiled).otherwise(F.col("text")).alias("text"))


def run_digests(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of find_runs(): the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    df = runs.select(key, F.size("runs").cast("long").alias("n_runs"), longest.alias("__longest"),
                     F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("__longest.minus")
    return df.select(key, "n_runs", F.col("__longest.start").alias("start"), length.alias("length"), F.col("__longest.period").alias("period"),
                     F.floor(1000 * length / F.col("__longest.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
