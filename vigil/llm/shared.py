"""Helpers that several operators use: shared folder, written intermediates, bounded text blocks, word hashes."""
from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one Python step holds as words at a time.
BLOCK_BYTES = 2 << 20
#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 8 << 20
#: Entries that a worker's cache may hold before it is emptied: token ids or counts, word hashes.
CACHE_WORDS, CACHE_HASHES = 250_000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see.

    Where the setting is absent a local master (tests) gets a temporary
    folder; any other master raises, as executors would not share it.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="vigil-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, options: dict | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**(options or {"compression": "zstd"})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by the tasks that it runs."""
    mod = sys.modules.setdefault("_vigil_llm_cache", types.ModuleType("_vigil_llm_cache"))
    return mod.__dict__.setdefault(name, {})


def small_batches(df: DataFrame) -> DataFrame:
    """Has the session send Arrow batches of at most BATCH_BYTES (it keeps a smaller setting of its own).

    Executors hold a batch several times, in the JVM and in each worker; texts
    make Spark's default of 10,000 rows or 64 MB too large for small executors.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number = conf.get(name).rstrip("b")  # Spark's default, too, is given in bytes
    if not number.lstrip("-").isdigit() or not 0 < int(number) <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded_sample(rows: DataFrame, key: str, max_bytes: int) -> list:
    """Rows (key, text, ...) of a small table, one per key, in the order of the key's hash until max_bytes of text are full.

    Of a key's rows the one whose text has the smallest hash stands for all;
    aggregation before the shuffle keeps a key that holds much of a table at
    one row per task.  At least one row comes back if there is any.
    """
    others = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))).alias("r"))
    one = written(one.select(key, "r.*"))
    chosen, total = [], 0
    for r in one.select(key, F.octet_length("text").alias("size")).orderBy(F.xxhash64(key), key).collect():
        total += r["size"] or 0
        if chosen and total > max_bytes:
            break
        chosen.append(r[key])
    return one.filter(F.col(key).isin(chosen)).collect()


def texts(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep..., text as UTF-8 bytes, null as empty), nothing else: clashing extra columns never reach a worker."""
    return small_batches(docs).select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def blocks(batches: Iterable, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(other columns as row tuples, texts) in runs of at most max_bytes of text, or one longer text alone."""
    import pyarrow.compute as pc
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        for a, b in runs_of(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), max_bytes):
            cut = batch.slice(a, b - a)
            yield list(zip(*(cut.column(n).to_pylist() for n in names))), cut.column("text").to_pylist()


def append(df: DataFrame, start, fields: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """df with further columns computed from its texts in Python, every other column passed on as it is.

    start() is called once in a task and returns run(texts as bytes, rows as
    a record batch) -> Arrow arrays for fields, (name, type) each.  run gets at
    most BLOCK_BYTES of text at once, or one longer text.
    """
    small_batches(df)
    added = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in fields))
    schema = StructType(df.schema.fields + added.fields)
    names = schema.fieldNames()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        compute = start()
        for batch in batches:
            column = batch.column(text)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for a, b in runs_of(sizes):
                part = batch.slice(a, b - a)
                data = [t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *compute(data, part)], names)

    return df.mapInArrow(run, schema)


def runs_of(sizes: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of at most ``most`` in sum, or of one longer entry."""
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


class Memo(dict):
    """key -> compute(key), in two generations of at most ``most`` entries each.

    A full young generation becomes the old one; an entry that is asked for
    again moves to the young one, so frequent keys stay and rare ones go.
    """

    def __init__(self, most: int = CACHE_WORDS):
        super().__init__()
        self.most, self.old = most, {}

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed once per worker and word; emptied when it holds CACHE_HASHES."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= CACHE_HASHES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    cache = worker_cache("words")
    table = cache.get("t")
    if table is None:
        table = cache["t"] = WordHashes()
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, others follow from 256."""
    stays = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in stays else chr(next(others)) for b in range(256)]
