"""rule_match for rules DataFrames of any length: neither the driver nor a worker holds the rules.

1. Rules stay a table.  Their patterns are compiled by the executors' JVM and
   reduced to literals there; a pattern is looked up by the literals that the
   fewest patterns share, as counted in a table of fixed size (``_Shared``).
2. Of these literals a bit table goes to the workers (``literal_filter``: 8 to 16 bits
   a literal, of a bounded size; beyond it more pieces pass).  A file's content
   is read once; its pieces that the table lets through meet the literals in an
   equi-join, a row per piece and batch of files.  A word boundary after a
   literal counts, and so do the choices of literals that most patterns need
   besides.
3. The (file, rule) pairs and their patterns meet the contents in one more join,
   by a hash of the file, and Spark's regexes decide.  Two files with one hash
   get each other's pairs, which their contents and languages sort out.

Rules with a pattern that no literal picks are searched everywhere, which is
what they ask for.  Contents are shuffled once and files read twice, three
times if there are such rules.
"""
from __future__ import annotations

import sys
import types
import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.severity import normalize_severity
from vigil.operators.rulematch import SHORTEST, _choices, _parsed
from vigil.operators.rulescan import located, rows_of, searched
from vigil.operators.wordlists import automaton
from vigil.session import materialized

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: A word boundary inside a literal (a code point that stands for no character).
EDGE = "\U0010FFFF"
#: Longer literals are looked up by their first characters.
LONGEST = 64
#: Pieces are tested by prefixes of these lengths before they are by their own.
STEPS = (1, 2, 3, 4, 8, 16, 32, 64)
#: Choices of literals that are told by a bit of the file.
NEEDS = 32
#: Characters that are hashed at a time.
WINDOW = 1 << 18
#: Tasks that build the tables; powers of 2 of the places for counts, first characters and (at most) literals.
BUILDERS, COUNT_BITS, PREFIX_BITS, MOST_BITS = 16, 20, 21, 27
#: Between files: no character.
GAP = 0x110000
WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def edged_sets(pattern: str) -> list[tuple[str, ...]]:
    """required_sets with a sign before each literal: 1 if no letter, digit or _ can follow, else 0.  Empty if there are none to name."""
    tree = _parsed(pattern)
    choices = {tuple(sorted({_edged(w) for w in c})) for c in (_choices(tree, EDGE) if tree else [])}
    choices = sorted(c for c in choices if all(len(w) > 1 for w in c))
    return choices if any(min(map(len, c)) > SHORTEST for c in choices) else []


def _edged(word: str) -> str:
    bare = word.replace(EDGE, "")
    ends = word.endswith(EDGE) and bare[-1:] and bare[-1] in WORD and len(bare) <= LONGEST
    return ("1" if ends else "0") + bare[:LONGEST]


# ---------------------------------------------------------------- hashes ---
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_hashes(words: list[str]) -> np.ndarray:
    """A hash of every word: that of the same piece of a text (``_Reader``)."""
    out, by_length = np.zeros(len(words), np.uint64), {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for n, rows in by_length.items():
        codes = _codes("".join([words[k] for k in rows])).reshape(len(rows), n).astype(np.uint64)
        out[rows] = (codes * _powers(BASE, n)).sum(axis=1, dtype=np.uint64)
    return out


def _first_slots(mixed: np.ndarray) -> np.ndarray:
    """Places in the table of first characters of hashes that were multiplied by MIX."""
    return (mixed >> np.uint64(64 - PREFIX_BITS)).view(np.int64)


def _slots(hashes: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Places of the hashes in a table of 2 ** bits; kinds of pieces have places of their own."""
    x = hashes + np.uint64(kind * MIX & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(31)
    x *= np.uint64(MIX)
    return x >> np.uint64(64 - bits)


def _set(table: np.ndarray, slots: np.ndarray) -> None:
    np.bitwise_or.at(table, slots >> np.uint64(3), np.left_shift(np.uint8(1), (slots & np.uint64(7)).astype(np.uint8)))


def _has(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


# ----------------------------------------------------------------- rules ---
def rules_table(rules: DataFrame) -> DataFrame:
    """One row per rule id (the last in load_ord order): its values, its patterns that Java compiles and their literals (``sets``)."""
    names = [f.name for f in rules.schema.fields if f.name not in ("load_ord", "rule_id")]
    rows = rules.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.groupBy("rule_id").agg(F.max_by(F.struct(*names), F.struct("load_ord", "_row")).alias("r")).select("rule_id", "r.*")
    good = F.filter(F.coalesce(F.col("patterns").cast("array<string>"), F.array().cast("array<string>")), lambda p: p.isNotNull() & F.try_reflect(
        F.lit("java.util.regex.Pattern"), F.lit("compile"), p).isNotNull())
    cwe, owasp = F.coalesce(F.col("cwe").cast("string"), F.lit("")), F.coalesce(F.col("owasp").cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    rows = rows.select(
        F.col("rule_id").cast("string").alias("rule_id"), good.alias("patterns"),
        F.struct(*[F.col(c).cast("string").alias(c) for c in ("name", "description")], normalize_severity(F.col("severity").cast("string")).alias("severity"),
                 *[F.col(c).cast("string").alias(c) for c in ("cwe", "owasp")],
                 F.coalesce(F.col("fix_suggestion").cast("string"), F.lit("")).alias("fix_suggestion"),
                 F.coalesce(F.col("tags").cast("array<string>"), none).alias("tags"),
                 F.array(F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.regexp_replace(cwe, "(?s)^(.*?)CWE-", "$1"), F.lit(".html")),
                         F.concat(F.lit("https://owasp.org/Top10/"), owasp, F.lit("/"))).alias("references")).alias("values"),
        F.coalesce(F.col("languages").cast("array<string>"), F.array(F.lit("*"))).alias("languages")).filter(F.size("patterns") > 0)
    kinds = "rule_id string, languages array<string>, patterns array<string>"

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            sets = pa.array([[edged_sets(p) for p in patterns] for patterns in batch.column("patterns").to_pylist()], pa.list_(pa.list_(pa.list_(pa.string()))))
            yield pa.RecordBatch.from_arrays([*batch.columns, sets], [*batch.schema.names, "sets"])

    held = dict(rows.dtypes)["values"]
    x = rows.select("rule_id", "languages", "patterns", "values").mapInArrow(run, f"{kinds}, values {held}, sets array<array<array<string>>>")
    return materialized(x)


def _listed(languages: Column) -> Column:
    return F.exists(languages, lambda x: (x == "*") | x.eqNullSafe(F.col("language")))


class _Shared:
    """How many patterns share a literal, about, and the choices of literals that most of them need."""

    def __init__(self, picked: DataFrame):
        tables, choices, self.words = np.zeros(1 << COUNT_BITS, np.int64), Counter(), 0

        def run(batches):
            import pyarrow as pa
            counts, most, words = np.zeros(1 << COUNT_BITS, np.int64), Counter(), 0
            for batch in batches:
                sets = [c for patterns in batch.column("sets").to_pylist() for s in patterns for c in s]
                held = [w[1:] for c in sets for w in c]
                words += len(held)
                counts += np.bincount(_slots(word_hashes(held), 0, COUNT_BITS).astype(np.int64), minlength=1 << COUNT_BITS)
                most.update(tuple(c) for c in sets if min(map(len, c)) > SHORTEST)
                if len(most) > 200_000:
                    most = Counter(dict(most.most_common(20_000)))
            top = [(list(c), n) for c, n in most.most_common(1000)]
            yield pa.RecordBatch.from_arrays([
                pa.array([zlib.compress(np.minimum(counts, 2 ** 31 - 1).astype(np.int32).tobytes(), 1)], pa.binary()), pa.array([words], pa.int64()),
                pa.array([[c for c, _ in top]], pa.list_(pa.list_(pa.string()))), pa.array([[n for _, n in top]], pa.list_(pa.int64()))],
                ["counts", "words", "choices", "times"])

        for r in picked.select("sets").coalesce(BUILDERS).mapInArrow(
                run, "counts binary, words long, choices array<array<string>>, times array<long>").collect():
            tables += np.frombuffer(zlib.decompress(r.counts), np.int32)
            self.words += r.words
            for c, n in zip(r.choices, r.times):
                choices[tuple(c)] += n
        self.counts = np.minimum(tables, 2 ** 31 - 1).astype(np.int32)
        #: choice -> its bit
        self.needs = {c: 1 << k for k, (c, n) in enumerate(choices.most_common(NEEDS)) if n > 1}


def keyed_words(picked: DataFrame, shared: _Shared) -> DataFrame:
    """(piece, rule_id, languages, pattern_no, pattern, needs): every literal that a pattern is looked up by, and the bits that it needs."""
    shipped = picked.sparkSession.sparkContext.broadcast((shared.counts, shared.needs))

    def run(batches):
        import pyarrow as pa
        counts, needs = shipped.value
        for batch in batches:
            rows = ([], [], [], [], [], [])
            all_sets = batch.column("sets").to_pylist()
            words = [w[1:] for patterns in all_sets for s in patterns for c in s for w in c]
            seen = iter(counts[_slots(word_hashes(words), 0, COUNT_BITS)].tolist())
            for rule, langs, patterns, sets in zip(batch.column("rule_id").to_pylist(), batch.column("languages").to_pylist(),
                                                   batch.column("patterns").to_pylist(), all_sets):
                for no, (pattern, choices) in enumerate(zip(patterns, sets)):
                    cost = [(max([next(seen) for _ in c]), 1 - min(map(len, c)), len(c)) for c in choices]
                    key = choices[min(range(len(choices)), key=cost.__getitem__)]
                    bits = sum({needs.get(tuple(c), 0) for c in choices if c is not key})
                    for w in key:
                        for column, value in zip(rows, (w, rule, langs, no, pattern, bits)):
                            column.append(value)
            kinds = pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["piece", "rule_id", "languages", "pattern_no", "pattern", "needs"])

    return picked.select("rule_id", "languages", "patterns", "sets").mapInArrow(
        run, "piece string, rule_id string, languages array<string>, pattern_no int, pattern string, needs long")


# ----------------------------------------------------------------- files ---
def _kind(length: int, ends: bool) -> int:
    return 2 * length + ends


def _prefixes(length: int) -> list[int]:
    """Lengths of the prefixes that a literal is tested by, beside its own: a fitting step of up to 4 and those of 8 and above."""
    first = max(s for s in STEPS[:4] if s <= length)
    return [first, *(s for s in STEPS[4:] if s <= length)]


def literal_filter(pieces: DataFrame, shared: _Shared) -> dict:
    """Tables of literals: a byte for each of their first characters (up to 4) in one, a bit for longer prefixes and whole literals in the other."""
    bits = min(MOST_BITS, max(16, (8 * shared.words).bit_length()))

    def run(batches):
        import pyarrow as pa
        first, whole, kinds = np.zeros(1 << PREFIX_BITS, np.uint8), np.zeros(1 << bits - 3, np.uint8), set()
        for batch in batches:
            by_kind: dict = {}
            for w in set(batch.column(0).to_pylist()):
                by_kind.setdefault((len(w) - 1, w[0] == "1"), []).append(w[1:])
            for (n, ends), words in by_kind.items():
                _add(first, whole, n, ends, words, bits)
            kinds.update(by_kind)
        yield pa.RecordBatch.from_arrays([
            pa.array([zlib.compress(t.tobytes(), 1)], pa.binary()) for t in (first, whole)] + [pa.array([[_kind(n, e) for n, e in kinds]], pa.list_(pa.int32()))],
            ["first", "whole", "kinds"])

    first, whole, kinds = np.zeros(1 << PREFIX_BITS, np.uint8), np.zeros(1 << bits - 3, np.uint8), set()
    for r in pieces.coalesce(BUILDERS).mapInArrow(run, "first binary, whole binary, kinds array<int>").collect():
        first |= np.frombuffer(zlib.decompress(r.first), np.uint8)
        whole |= np.frombuffer(zlib.decompress(r.whole), np.uint8)
        kinds.update(r.kinds)
    # the words of the needs are let through as well: their hashes set a file's bits
    needed: dict[str, int] = {}
    for choice, bit in shared.needs.items():
        for w in choice:
            needed[w[1:]] = needed.get(w[1:], 0) | bit
    for w in needed:
        _add(first, whole, len(w), False, [w], bits)
        kinds.add(_kind(len(w), False))
    hashes = word_hashes(list(needed))
    order = np.argsort(hashes)
    return {"bits": bits, "first": first, "whole": whole, "kinds": sorted((k // 2, bool(k % 2)) for k in kinds),
            "need_hashes": hashes[order], "need_bits": np.array(list(needed.values()), np.int64)[order]}


def _add(first: np.ndarray, whole: np.ndarray, length: int, ends: bool, words: list[str], bits: int) -> None:
    for s in _prefixes(length):
        hashes = word_hashes([w[:s] for w in words])
        if s <= 4:
            first[_first_slots(hashes * np.uint64(MIX))] = 1
        else:
            _set(whole, _slots(hashes, _kind(LONGEST + s, False), bits))
    _set(whole, _slots(word_hashes(words), _kind(length, ends), bits))


class _Reader:
    """A literal_filter in a worker."""

    def __init__(self, found: dict):
        self.f = types.SimpleNamespace(**found)
        most = 2 * (WINDOW + LONGEST + 2)
        self.powers, self.inverse = _powers(BASE, most), _powers(pow(BASE, -1, 1 << 64), most)
        self.mixed, self.first = self.inverse * np.uint64(MIX), self.f.first.view(np.bool_)
        self.wordly = np.zeros(128, bool)
        self.wordly[[ord(c) for c in WORD]] = True
        self.by_step: dict = {}  # first step -> kinds
        for n, ends in self.f.kinds:
            self.by_step.setdefault(_prefixes(n)[0], []).append((n, ends))

    def windows(self, texts: list):
        """[(number, part of a text)]: all of them, long texts in parts that overlap."""
        held, size = [], 0
        for number, text in enumerate(texts):
            for a in range(0, len(text), WINDOW):
                part = text[a:a + WINDOW + LONGEST + 1]
                held.append((number, part))
                size += len(part) + 1
                if size >= WINDOW:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def hits(self, window: list, bits: np.ndarray):
        """(number of the text, literal with its sign), once each, of pieces that may be literals; sets the needs' bits of the texts."""
        codes = _codes("\0".join([t for _, t in window]) + "\0").copy()
        lengths = np.array([len(t) for _, t in window])
        ends = np.cumsum(lengths + 1) - 1
        codes[ends] = GAP
        codes[(codes >= 65) & (codes <= 90)] += np.uint32(32)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.powers[:len(codes)], out=sums[1:], dtype=np.uint64)

        def hashes(at, n):
            return (sums[at + n] - sums[at]) * self.inverse[at]

        def tested(at, n, table, slot_kind, table_bits, ends_word=False):
            """Those of the places whose piece of n characters lies in the table (and ends a word), and its hashes."""
            at = at[at + n < len(sums) - 1]
            if ends_word:
                after = codes[at + n]
                at = at[(after >= 128) | ~self.wordly[np.minimum(after, 127)]]
            h = hashes(at, n)
            ok = _has(table, _slots(h, slot_kind, table_bits))
            return at[ok], h[ok]

        f = self.f
        for step, kinds in self.by_step.items():
            n_all = len(codes) - step
            if n_all <= 0:
                continue
            h = sums[step:step + n_all] - sums[:n_all]
            h *= self.mixed[:n_all]
            places = {step: np.flatnonzero(self.first[_first_slots(h)])}
            for n, ends_word in kinds:
                deepest = step
                for s in _prefixes(n)[1:]:
                    if s not in places:
                        places[s] = tested(places[deepest], s, f.whole, _kind(LONGEST + s, False), f.bits)[0]
                    deepest = s
                at, h = tested(places[deepest], n, f.whole, _kind(n, ends_word), f.bits, ends_word)
                file = np.searchsorted(ends, at)
                inside = at + n <= ends[file]
                at, h, file = at[inside], h[inside], file[inside]
                if not len(at):
                    continue
                _, once = np.unique(h ^ (file.astype(np.uint64) * np.uint64(MIX)), return_index=True)
                at, h, file = at[once], h[once], file[once]
                if len(f.need_hashes) and not ends_word:
                    k = np.minimum(np.searchsorted(f.need_hashes, h), len(f.need_hashes) - 1)
                    same = f.need_hashes[k] == h
                    np.bitwise_or.at(bits, [window[x][0] for x in file[same].tolist()], f.need_bits[k[same]])
                sign = "1" if ends_word else "0"
                text = codes[at[:, None] + np.arange(n)].tobytes().decode("utf-32-le", "surrogatepass")
                for j, x in enumerate(file.tolist()):
                    yield window[x][0], sign + text[j * n:j * n + n]


def file_pieces(files: DataFrame, found: dict) -> DataFrame:
    """(piece, language, files): pieces that may be literals, a row per batch, with the files' keys and bits."""
    shipped, key = files.sparkSession.sparkContext.broadcast(found), uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa
        reader = automaton(key, lambda: _Reader(shipped.value))
        for batch in batches:
            texts, languages = batch.column("content").to_pylist(), batch.column("language").to_pylist()
            keys, bits = batch.column("file").to_numpy(zero_copy_only=False), np.zeros(len(texts), np.int64)
            held: dict = {}
            for window in reader.windows(texts):
                for number, piece in reader.hits(window, bits):
                    held.setdefault((piece, languages[number]), []).append(number)
            rows = np.array([n for numbers in held.values() for n in numbers], np.int64)
            offsets = np.cumsum([0, *map(len, held.values())])
            pairs = pa.StructArray.from_arrays([pa.array(keys[rows], pa.int64()), pa.array(bits[rows], pa.int64())], ["file", "bits"])
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([g for _, g in held], pa.string()),
                                              pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], ["piece", "language", "files"])

    return files.select("file", "language", "content").mapInArrow(run, "piece string, language string, files array<struct<file:bigint,bits:bigint>>")


def file_pairs(files: DataFrame, picked: DataFrame) -> DataFrame:
    """(file, rule_id, tries): the files that some rule can match, and the rule's patterns that can, in list order."""
    shared = _Shared(picked)
    words = keyed_words(picked, shared)
    pieces = file_pieces(files, literal_filter(words.select("piece"), shared))
    x = pieces.hint("merge").join(words.hint("merge"), "piece").filter(_listed(F.col("languages")))
    x = x.select(F.explode("files").alias("f"), "rule_id", "pattern_no", "pattern", "needs") \
        .filter(F.col("needs").bitwiseAND(F.col("f.bits")) == F.col("needs"))
    x = x.select("f.file", "rule_id", F.struct("pattern_no", "pattern").alias("try")).repartition("file")
    return x.groupBy("file", "rule_id").agg(F.array_sort(F.collect_set("try")).alias("tries"))


def joined_rule_match(files: DataFrame, rules: DataFrame, max_bytes: int) -> DataFrame:
    """rule_match's rows for rules (the columns of ``pack_of``, no null ids) of any number; up to ``max_bytes`` may be broadcast."""
    table = rules_table(rules)
    everywhere = F.exists("sets", lambda s: F.size(s) == 0)
    files = files.select("path", "language", "content").filter("content IS NOT NULL")
    keyed = files.withColumn("file", F.xxhash64("path", "language", "content"))
    pairs = file_pairs(keyed, table.filter(~everywhere))
    x = keyed.hint("merge").join(pairs.hint("merge"), "file").select("path", "language", "content", "rule_id", "tries")
    always = table.filter(everywhere).select("rule_id", "languages", F.transform(
        "patterns", lambda p, k: F.struct(k.alias("pattern_no"), p.alias("pattern"))).alias("tries"))
    size, count = always.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*always.columns))).cast("long")), F.lit(0)), F.count("*")).first()
    if count:
        side = F.broadcast(always) if size <= max_bytes else always
        x = x.unionByName(files.join(side, _listed(F.col("languages"))).select(*x.columns))
    hits = located(searched(x)).select("rule_id", "path", "language", "line", "pattern_ord")
    values = table.select("rule_id", "languages", "values")
    return rows_of(hits.hint("merge").join(values.hint("merge"), "rule_id").filter(_listed(F.col("languages"))).select(*hits.columns, "values.*"))
