"""Benchmark decontamination (3): suffix arrays over the training texts.

Every block of training documents is a shard: its words become ids of the
benchmark's vocabulary, and its suffixes are sorted into a suffix array by their
first ``window`` words.  Suffixes whose first words begin no benchmark window
can match nothing and are left out of the array.  Every benchmark suffix is
looked up by binary search; the equal range in the array holds all its
occurrences.  Runs of occurrences at consecutive words hold the longest verbatim
matches of an item; inside a run, the item's suffix automaton tells them apart
(neighbouring windows of a document need not be neighbours in the item).
Matches come with their places in the document and in the item.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is
``window`` consecutive words of an item; an item of fewer words, but not none,
is one window.  Null texts have no words; an item without an id counts as a hit
but is not listed; items that share an id are one item; an empty benchmark
marks nothing; repeated documents are judged each.

The benchmark goes to the workers in parts of at most ITEM_BYTES of text; a
larger benchmark is searched for part by part over written tables.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import append, free_name, written

WINDOW = 10
#: Bytes of benchmark text that a worker holds at once.
ITEM_BYTES = 16 << 20
#: Lower-cases A-Z and turns what is no word character into a space.
TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
                 for c in range(256))
FILTER_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


def _slot(*columns: np.ndarray) -> np.ndarray:
    """Slot of the leading words in a table of 2^FILTER_BITS marks."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _keys(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Suffixes as byte strings that sort as their first words do; id 0 is below all others."""
    rows = ids[at[:, None] + np.arange(window)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * window}").ravel()


class Benchmark:
    """Windows of the items, ready to be searched for in shards."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window, self.vocabulary = window, Vocabulary()
        vocabulary, found = self.vocabulary, {}
        for item, (_, text) in enumerate(items):
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            for start in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[start:start + window]), set()).add(item)
        self.names, self.words, self.automata = [name for name, _ in items], {}, {}
        for item, (_, text) in enumerate(items):
            self.words[item] = [vocabulary[w] for w in words_of(text)]
        windows = sorted(found)
        self.items = [sorted(found[w]) for w in windows]
        self.lengths = np.array([len(w) for w in windows], np.int64)
        low = np.zeros((len(windows), window), ">u4")
        high = np.full((len(windows), window), 0xFFFFFFFF, ">u4")
        for k, w in enumerate(windows):
            low[k, :len(w)] = high[k, :len(w)] = w
        self.low, self.high = (x.view(f"S{4 * window}").ravel() if len(windows) else None for x in (low, high))
        self.leads = []  # (words that a lead has, marks of the leads)
        for n in (1, 2, 3):
            some = [w for w in windows if (len(w) == n if n < 3 else len(w) >= 3)]
            if some:
                marks = np.zeros(1 << FILTER_BITS, bool)
                marks[_slot(*np.array([w[:n] for w in some]).T)] = True
                self.leads.append((n, marks))

    def search(self, docs: list[bytes]) -> list[tuple]:
        """Per document of a shard: (words, hit words as (start, end) runs, {item: [(start, length, start in the item)...]})."""
        lookup = self.vocabulary.__getitem__
        ids_of = [np.fromiter(map(lookup, w), np.int64, len(w)) for w in map(words_of, docs)]
        sizes = np.array([len(x) for x in ids_of])
        gap = np.zeros(self.window, np.int64)
        ids = np.concatenate([x for d in ids_of for x in (d, gap)]) if docs else gap
        begin = np.concatenate([[0], np.cumsum(sizes + self.window)])
        out = [(int(n), [], {}) for n in sizes]
        if self.low is None:
            return out
        chosen = np.zeros(len(ids), bool)
        for n, marks in self.leads:
            m = len(ids) - n + 1
            columns = [ids[k:k + m] for k in range(n)]
            at = np.flatnonzero(np.logical_and.reduce([c > 0 for c in columns]))
            chosen[at[marks[_slot(*(c[at] for c in columns))]]] = True
        at = np.flatnonzero(chosen)
        if not len(at):
            return out
        padded = np.concatenate([ids, gap])
        keys = _keys(padded, at, self.window)
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], at[order]  # the suffix array of the shard
        first = np.searchsorted(keys, self.low, side="left")
        last = np.searchsorted(keys, self.high, side="right")
        places: dict[int, dict] = {}
        for k in np.flatnonzero(last > first):
            where = suffixes[first[k]:last[k]]
            for d, start in zip(np.searchsorted(begin, where, side="right") - 1, where):
                spots = places.setdefault(int(d), {})
                for item in self.items[k]:
                    spots.setdefault(item, []).append((int(start - begin[d]), int(self.lengths[k])))
        for d, spots in places.items():
            runs = {item: _runs(found) for item, found in spots.items()}
            covered = _union([(s, s + n) for some in runs.values() for s, n in some])
            out[d] = (out[d][0], covered, {item: self._matches(item, some, ids_of[d]) for item, some in runs.items()})
        return out

    def _matches(self, item: int, runs: list[tuple[int, int]], ids: np.ndarray) -> list[tuple[int, int, int]]:
        if item not in self.automata:
            self.automata[item] = Automaton(self.words[item])
        least = min(self.window, len(self.words[item]))
        return [(s + a, n, b) for s, size in runs for a, n, b in self.automata[item].matches(ids[s:s + size].tolist(), least)]


def _runs(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Occurrences at consecutive words merge into (start, words)."""
    out: list[list[int]] = []
    for start, n in sorted(set(found)):
        if out and start <= out[-1][2] + 1:
            out[-1][1], out[-1][2] = max(out[-1][1], start + n), start
        else:
            out.append([start, start + n, start])
    return [(s, e - s) for s, e, _ in out]


class Automaton:
    """Suffix automaton of an item's word numbers: its states are the sets of places at which a run of words ends."""

    def __init__(self, words: list[int]):
        self.to, self.link, self.length, self.ends = [{}], [-1], [0], [-1]
        last = 0
        for k, w in enumerate(words):
            state = self._state({}, 0, self.length[last] + 1, k)
            at = last
            while at >= 0 and w not in self.to[at]:
                self.to[at][w] = state
                at = self.link[at]
            if at >= 0:
                q = self.to[at][w]
                if self.length[q] == self.length[at] + 1:
                    self.link[state] = q
                else:
                    copy = self._state(dict(self.to[q]), self.link[q], self.length[at] + 1, self.ends[q])
                    while at >= 0 and self.to[at].get(w) == q:
                        self.to[at][w] = copy
                        at = self.link[at]
                    self.link[q] = self.link[state] = copy
            last = state

    def _state(self, to: dict, link: int, length: int, end: int) -> int:
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(end)
        return len(self.to) - 1

    def matches(self, words: list[int], least: int) -> list[tuple[int, int, int]]:
        """(start, length, start in the item) of all matches of at least ``least`` words that no word extends on either side."""
        out, state, n = [], 0, 0
        for k, w in enumerate([*words, 0]):  # 0 is no word of any item
            before, kept = state, n
            while state and w not in self.to[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.to[state]:
                state, n = self.to[state][w], n + 1
            if n <= kept and kept >= least:
                out.append((k - kept, kept, self.ends[before] - kept + 1))
        return out


def _union(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


FOUND = "__found"
FOUND_TYPE = ("struct<n_words:bigint,hit:array<struct<start:int,end:int>>,"
              "matches:array<struct<item_id:bigint,start:int,length:int,item_start:int>>>")


def _search(docs: DataFrame, items: list[tuple], window: int, out: str, earlier: str | None) -> DataFrame:
    """docs with the column ``out``; what an earlier part of the benchmark found (column ``earlier``) is kept."""

    def start():
        import pyarrow as pa
        bench = Benchmark(items, window)
        kind = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                          ("matches", pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()),
                                                         ("item_start", pa.int32())])))])

        def run(data, part):
            rows = []
            for n, hit, matches in bench.search(data):
                rows.append({"n_words": n, "hit": [{"start": s, "end": e} for s, e in hit],
                             "matches": [{"item_id": bench.names[i], "start": s, "length": k, "item_start": at}
                                         for i, some in sorted(matches.items()) for s, k, at in some]})
            if earlier:
                for row, old in zip(rows, part.column(earlier).to_pylist()):
                    both = _union([(x["start"], x["end"]) for x in row["hit"] + old["hit"]])
                    row["hit"] = [{"start": s, "end": e} for s, e in both]
                    row["matches"] = old["matches"] + row["matches"]
            return [pa.array(rows, kind)]
        return run

    return append(docs, start, [(out, FOUND_TYPE)])


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, out: str = FOUND) -> DataFrame:
    """docs with ``out``: word count, hit word runs [start, end), and each item's longest matches with their places."""
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // ITEM_BYTES))
    for part in range(parts):
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        rows, earlier = [(r[0], bytes(r[1])) for r in mine.collect()], None
        if part:
            earlier = free_name(docs, FOUND + "_before")
            docs = written(docs).withColumnRenamed(out, earlier)
        docs = _search(docs, rows, window, out, earlier)
        docs = docs.drop(earlier) if earlier else docs
    return docs


def _total(hit):
    return F.aggregate(hit, F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words inside matches, and digest of the items that occur."""
    found = find_matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window)
    names = F.array_sort(F.array_distinct(F.transform(
        F.filter(F.col(FOUND)["matches"], lambda m: m["item_id"].isNotNull()), lambda m: m["item_id"].cast("string"))))
    return (found.select("doc_id", F.col(FOUND)["n_words"].alias("n_words"), _total(F.col(FOUND)["hit"]).alias("n_hit"),
                         names.alias("names"), F.col(FOUND)["matches"].alias("matches"))
            .select("doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"),
                    F.sha2(F.array_join("names", ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"), "matches"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their columns."""
    out = free_name(docs, FOUND)
    found = find_matches(docs, benchmark, window, out)
    return found.filter(F.size(F.col(out)["hit"]) == 0).drop(out)
