"""Names and lines against lists of any length (J3 with user lists): Aho-Corasick, one pass over a text.

A list of at most ``max_bytes`` becomes one automaton per Python worker; a text
is read once, however many entries there are, and the hit that comes first in
list order is kept, as a scan of the list with ``contains`` would find it.

A longer list never leaves the executors: it is reduced to one row per group
and entry, and the distinct texts' pieces (of the lengths that entries have)
meet it in an equi-join.  Pieces grow with a text's length times the number of
different entry lengths, never with the number of entries.
"""
from __future__ import annotations

import sys
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil.session import materialized

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

MAX_LIST_BYTES = 64 << 20
#: Lists of names up to here pass through the driver.
MAX_ENTRY_BYTES = 4 << 20
#: A text of more rows than this is not dealt by its own value when hits go back to the rows.
HOT_ROWS = 1 << 16
#: Pieces of a batch between a worker and Spark.
PIECES = 20_000
HIT = "struct<ord:bigint,entry:string>"


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker."""
    return sys.modules.setdefault("_vigil_wordlists", types.ModuleType("_vigil_wordlists")).__dict__.setdefault("cache", {})


def automaton(key: str, build):
    """build()'s result, once per worker; an earlier one makes room."""
    cache = worker_cache()
    if key not in cache:
        cache.clear()
        cache[key] = build()
    return cache[key]


def _entries_automaton(rows: list[tuple]):
    """(automaton with {group: smallest ord} at every entry, the same of the empty entry, which every text holds)."""
    import ahocorasick
    words: dict[str, dict] = {}
    for group, entry, order in rows:
        at = words.setdefault(entry, {})
        at[group] = min(order, at.get(group, order))
    a = ahocorasick.Automaton()
    for word, at in words.items():
        if word:
            a.add_word(word, (word, at))
    if len(a):
        a.make_automaton()
    return a, words.get("")


def _first(a, empty: dict | None, text: str, group) -> dict | None:
    best = None
    for word, at in ([("", empty)] if empty else []):
        for g in (group, None):
            if g in at and (best is None or at[g] < best[0]):
                best = (at[g], word)
    if len(a):
        for _, (word, at) in a.iter(text):
            order = min(at.get(group, sys.maxsize), at.get(None, sys.maxsize))
            if order < sys.maxsize and (best is None or order < best[0]):
                best = (order, word)
    return {"ord": best[0], "entry": best[1]} if best else None


def _pieces(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(text, grp, piece): every piece of a text that is as long as some entry."""

    def run(batches):
        import pyarrow as pa

        def batch_of(text, group, pieces):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (text, group, pieces)], ["text", "grp", "piece"])

        held = [], [], []
        for batch in batches:
            for text, group in zip(batch.column("text").to_pylist(), batch.column("grp").to_pylist()):
                for n in lengths:
                    if n > len(text):
                        break
                    for first in range(0, len(text) - n + 1, PIECES):
                        part = list({text[i:i + n] for i in range(first, min(first + PIECES, len(text) - n + 1))})
                        for column, values in zip(held, ([text] * len(part), [group] * len(part), part)):
                            column += values
                        if len(held[0]) >= PIECES or len(held[0]) * len(text) > 1 << 23:
                            yield batch_of(*held)
                            held = [], [], []
        if held[0]:
            yield batch_of(*held)

    return texts.select("text", "grp").mapInArrow(run, "text string, grp string, piece string")


def _by_join(df: DataFrame, text: str, group: str | None, entries: DataFrame, out: str) -> DataFrame:
    """first_listed for a list of any length."""
    df = materialized(df)
    keys = [F.col(text).cast("string").alias("text"), (F.col(group) if group else F.lit(None)).cast("string").alias("grp")]
    listed = materialized(entries.groupBy(F.col("entry").alias("piece"), F.col("grp").alias("of")).agg(F.min("ord").alias("ord")))
    lengths = sorted(r[0] for r in listed.select(F.char_length("piece")).distinct().collect())
    texts = materialized(df.select(*keys).filter("text IS NOT NULL").groupBy("text", "grp").agg(F.count("*").alias("n")))
    hits = _pieces(texts, lengths).join(listed, "piece").filter("of IS NULL OR of = grp") \
        .groupBy("text", "grp").agg(F.min(F.struct("ord", F.col("piece").alias("entry"))).alias("hit"))
    hot = F.broadcast(materialized(texts.filter(F.col("n") > HOT_ROWS)))  # at most a row for HOT_ROWS rows of df

    def same(other):
        return keys[0].eqNullSafe(other["text"]) & keys[1].eqNullSafe(other["grp"])

    hits = materialized(texts.join(hits.withColumnsRenamed({"text": "t", "grp": "g"}), F.col("text").eqNullSafe(F.col("t"))
                                   & F.col("grp").eqNullSafe(F.col("g")), "left").select("text", "grp", "n", "hit"))
    few, many = hits.filter(F.col("n") > HOT_ROWS), hits.filter(F.col("n") <= HOT_ROWS)
    place = F.struct(F.col("hit.ord").alias("ord"), F.col("hit.entry").alias("entry"))
    placed = F.when(F.col("hit").isNotNull(), place).alias(out)
    none = df.filter(F.col(text).isNull()).withColumn(out, F.lit(None).cast(HIT))  # no key, no task for all of them
    some = df.filter(F.col(text).isNotNull())
    often = some.join(F.broadcast(few.alias("h")), same(few), "inner").select(*[df[c] for c in df.columns], placed)
    seldom = some.join(hot, same(hot), "left_anti")
    seldom = seldom.join(many, same(many), "left").select(*[df[c] for c in df.columns], placed)
    return often.unionByName(seldom).unionByName(none)


def first_listed(df: DataFrame, text: str, entries: DataFrame, out: str = "listed", group: str | None = None,
                 max_bytes: int = MAX_ENTRY_BYTES) -> DataFrame:
    """df plus ``out`` = struct(ord, entry) of the first listed entry that df's ``text`` contains, or null.

    entries(entry, ord[, group]): literals, compared as they are.  With
    ``group`` (a column of df and of entries) an entry holds for rows of its
    group, one with a null group for all.  Null texts have no hit; an entry
    listed twice counts at its first place; the empty entry is in every text.
    Lists of more than ``max_bytes`` of text are joined, not sent.
    """
    grouped = group is not None and group in entries.columns
    entries = entries.select((F.col(group) if grouped else F.lit(None)).cast("string").alias("grp"), "entry",
                             F.col("ord").cast("long").alias("ord")).filter("entry IS NOT NULL AND ord IS NOT NULL")
    size = F.coalesce(F.sum(F.octet_length("entry").cast("long") + 32), F.lit(0))
    if entries.agg(size).first()[0] > max_bytes:
        return _by_join(df, text, group if grouped else None, entries, out)
    names = df.columns
    schema = StructType(df.schema.fields + StructType.fromDDL(f"`{out}` {HIT}").fields)
    shipped, key = df.sparkSession.sparkContext.broadcast([tuple(r) for r in entries.collect()]), uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa
        a, empty = automaton(key, lambda: _entries_automaton(shipped.value))
        kind = pa.struct([("ord", pa.int64()), ("entry", pa.string())])
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            groups = batch.column(names.index(group)).to_pylist() if grouped else [None] * len(texts)
            seen: dict = {}
            for pair in zip(texts, groups):
                if pair not in seen:
                    seen[pair] = None if pair[0] is None else _first(a, empty, *pair)
            hits = pa.array([seen[pair] for pair in zip(texts, groups)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], schema.fieldNames())

    return df.mapInArrow(run, schema)


def listed_calls(calls: DataFrame, entries: DataFrame, max_bytes: int = MAX_ENTRY_BYTES) -> DataFrame:
    """Calls whose name contains a listed name of the file's language: (path, language, line, call_ord, name, list_ord, entry)."""
    c = first_listed(calls.select("path", "language", "line", "call_ord", "name"), "name", entries, "_hit", "language", max_bytes)
    return c.filter("_hit IS NOT NULL").select("path", "language", "line", "call_ord", "name", F.col("_hit.ord").alias("list_ord"),
                                               F.col("_hit.entry").alias("entry"))
