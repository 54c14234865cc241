"""Source files on storage (S1-S8) and dependency manifests.

``binaryFile`` lists and reads files in parallel.  Extension, exclusion and
size filters use the file's metadata only, so an excluded file is not opened;
contents are never shuffled.  Bytes are decoded as UTF-8 with malformed
sequences replaced by U+FFFD.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import catalog as C
from vigil.functions.paths import detect_language, excluded, extension, extension_order, validate_target

#: Names of a capped listing that are sent to every executor; more are joined as Spark plans it.
MOST_BROADCAST = 1_000_000
#: Largest file that one row holds.
MAX_FILE_BYTES = (1 << 31) - (1 << 20)


def relative_to(spark: SparkSession, root: str, uri: Column) -> Column:
    """Path below root of a file's URI, whichever way the root is spelt (relative, plain, ``file://``).

    The root is resolved as Spark resolves it; the result is plain text with
    '/' between its parts, or the file's name where the root is the file itself.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = store.makeQualified(path).toUri().getRawPath().rstrip("/")
    raw = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    below = F.when(raw.startswith(base + "/"), F.substr(raw, F.lit(len(base) + 2))) \
        .otherwise(F.regexp_extract(raw, r"([^/]*)$", 1))
    return F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B")))


def _extensions(language: str) -> list[str]:
    return [e for lang, es in C.FILE_EXTENSIONS.items() if language in ("auto", lang) for e in es]


def _any_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def select_files(raw: DataFrame, root: str, language: str, exclude) -> DataFrame:
    """Adds ``rel`` and keeps the files of the language that no glob excludes; works on file metadata only."""
    rel = relative_to(raw.sparkSession, root, F.col("_metadata.file_path"))
    keep = extension(rel).isin(*_extensions(language))
    if exclude:
        keep = keep & ~excluded(rel, list(exclude))
    return raw.filter(keep).withColumn("rel", rel)


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def listed_files(spark: SparkSession, root: str, language: str = "auto", exclude=tuple(C.DEFAULT_EXCLUDE_PATTERNS),
                 files_per_trigger: int | None = None) -> DataFrame:
    """binaryFile rows plus ``rel`` of the tree's files, or a stream of them; only rows whose content is asked for are opened.

    A file that cannot be read gives no row where its content is asked for.
    Spark does not list files of no bytes: they are neither scanned nor errors.
    """
    glob = "*{" + ",".join(_any_case(e) for e in _extensions(language)) + "}"
    reader = spark.read if files_per_trigger is None else spark.readStream.schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_trigger)
    raw = (reader.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
           .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root))
    return select_files(raw, root, language, exclude)


def named_files(spark: SparkSession, names: list[str], root: str, language: str = "auto") -> DataFrame:
    """listed_files of exactly these names (as in its ``path``) below root; names that are gone by now are left out."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [hadoop.Path(n) for n in names]
    there = [re.sub(r"([\\{}\[\]*?])", r"\\\1", n) for n, p in zip(names, paths) if p.getFileSystem(conf).exists(p)]
    if not there:
        return spark.createDataFrame([], BINARY_FILE + ", rel string")
    raw = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(there)
    return select_files(raw, root, language, ())


def contents(listed: DataFrame, language: str = "auto", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """source_files(path, language, content, size, modified) of listed files; larger ones are not opened."""
    lang = detect_language(F.col("rel")) if language == "auto" else F.lit(language)
    return listed.filter(F.col("length") <= max_bytes).select(
        F.col("rel").alias("path"), lang.alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def unscanned(listed: DataFrame, scanned: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, error) of listed files without a row in scanned(path); opens none of them."""
    failed = listed.select("rel", "length").join(scanned.select(F.col("path").alias("rel")), "rel", "left_anti")
    why = F.when(F.col("length") > max_bytes, F.format_string("%d bytes, more than %d", "length", F.lit(max_bytes))) \
        .otherwise(F.lit("cannot be read"))
    return failed.select(F.col("rel").alias("path"), F.concat(F.lit("Failed to analyze "), "rel", F.lit(": "), why).alias("error"))


def read_source_files(spark: SparkSession, root: str, language: str = "auto",
                      exclude=tuple(C.DEFAULT_EXCLUDE_PATTERNS), max_files: int | None = None,
                      relative: bool = True, max_bytes: int = MAX_FILE_BYTES, validate: bool = False) -> DataFrame:
    """source_files(path, language, content, size, modified) of a directory tree.

    language='auto': every known extension, language from the extension;
    otherwise only that language's extensions.  Exclusions are judged on the
    path below the root.  ``max_files`` keeps the first n files in (extension
    list, path) order; default: no cap.  Files that cannot be read, or that
    have more than ``max_bytes`` bytes, give no row here but one in ``file_errors``.
    ``validate`` refuses a root that is empty or holds '..' or NUL, for roots
    that come from outside.
    """
    if validate and (reason := validate_target(root)):
        raise ValueError(reason)
    d = listed_files(spark, root, language, exclude).filter(F.col("length") <= max_bytes)
    if max_files is not None:
        # the files to keep are chosen on names alone; contents are read for these only
        first = (d.select("rel", extension_order(F.col("rel")).alias("o")).orderBy("o", "rel").limit(max_files).select("rel"))
        d = d.join(F.broadcast(first) if max_files <= MOST_BROADCAST else first, "rel", "left_semi")
    lang = detect_language(F.col("rel")) if language == "auto" else F.lit(language)
    path = F.col("rel") if relative else F.regexp_replace("path", r"^file:(//)?(?=/)", "")
    return d.select(path.alias("path"), lang.alias("language"),
                    F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
                    F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_errors(spark: SparkSession, root: str, language: str = "auto", exclude=tuple(C.DEFAULT_EXCLUDE_PATTERNS),
                max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, error) of files of the tree that a scan cannot read: too large, or failing when opened.

    Opens every file; ``results.scan_tree`` gives the same rows out of the scan's own pass.
    """
    listed = listed_files(spark, root, language, exclude)
    readable = listed.filter((F.col("length") <= max_bytes) & (F.length("content") >= 0))
    return unscanned(listed, readable.select(F.col("rel").alias("path")), max_bytes)


def dependency_manifests(listing: DataFrame, root_col: str | None = None, roots: DataFrame | None = None) -> DataFrame:
    """Which dependency manifests exist directly under each project root.

    listing: any DataFrame with a ``path`` column (e.g. a file listing); the
    project root is the directory of each manifest unless ``root_col`` gives it.
    ``roots`` (a ``root`` column) adds roots that may have none at all.
    Returns (root, manifest, ord, present) with one row per (root, known manifest name).
    """
    base = F.element_at(F.split(F.col("path"), "/", -1), -1)
    root = F.col(root_col) if root_col else F.regexp_replace(F.col("path"), r"/?[^/]*$", "")
    found = listing.filter(base.isin(*C.DEPENDENCY_FILES)).select(root.alias("root"), base.alias("manifest")).distinct()
    every = found.select("root") if roots is None else found.select("root").unionByName(roots.select("root"))
    # every root with the manifest names: a literal array exploded per root (no join)
    names = F.array(*[F.struct(F.lit(n).alias("manifest"), F.lit(i).alias("ord")) for i, n in enumerate(C.DEPENDENCY_FILES)])
    grid = every.distinct().select("root", F.explode(names).alias("m")).select("root", "m.manifest", "m.ord")
    return grid.join(found.withColumn("present", F.lit(True)), ["root", "manifest"], "left") \
        .select("root", "manifest", "ord", F.coalesce("present", F.lit(False)).alias("present"))
