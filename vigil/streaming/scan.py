"""Streaming scan (X4): new source files -> findings, continuously or as an availableNow batch.

All built-in detectors are stateless per line, so the batch plan runs
unchanged on a file stream, with the batch scan's paths, extensions and
exclusions; a file has the same finding ids either way.  The file source
hands over each file once, and the sink's log makes each batch's output
exactly-once, so no state, no watermark and no lateness are needed: a file is
scanned whatever modification time it carries.  Fact tables that need windows
over whole files (class context, end lines, call graph) are kept by
``vigil.streaming.facts``; ``start_tree_scan`` adds errors and counts.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil import catalog as C
from vigil.operators.detect import detect
from vigil.operators.lines import annotate, explode_lines
from vigil.operators.results import scan_listed
from vigil.session import materialized
from vigil.sources.files import MAX_FILE_BYTES, contents, listed_files, named_files


def source_stream(spark: SparkSession, root: str, max_files_per_trigger: int = 1000, language: str = "auto",
                  exclude=tuple(C.DEFAULT_EXCLUDE_PATTERNS), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Streaming source_files(path, language, content, size, modified); max_files_per_trigger paces, it drops nothing.

    As in the batch reader, files of more than ``max_bytes`` bytes are not
    opened and unreadable ones give no row; start_tree_scan reports both.
    """
    return contents(listed_files(spark, root, language, exclude, max_files_per_trigger), language, max_bytes)


def stream_findings(files: DataFrame) -> DataFrame:
    """Findings of a file stream: the batch scan's rows."""
    return detect(annotate(explode_lines(files)))


def start_scan(spark: SparkSession, root: str, out_path: str, checkpoint: str, available_now: bool = True,
               exclude=tuple(C.DEFAULT_EXCLUDE_PATTERNS)):
    """Write findings of new files under ``root`` to parquet at ``out_path``."""
    f = stream_findings(source_stream(spark, root, exclude=exclude))
    w = f.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_tree_scan(spark: SparkSession, root: str, out: str, checkpoint: str, available_now: bool = True, language: str = "auto",
                    exclude=tuple(C.DEFAULT_EXCLUDE_PATTERNS), max_files_per_trigger: int = 1000, max_bytes: int = MAX_FILE_BYTES):
    """Findings, scanned files, errors and counts of new files, a partition batch=n of each table per micro-batch (see results.scan_tree).

    The stream carries names only, at most max_files_per_trigger of them a
    batch, which then opens every file once.  A batch that is run again writes
    its partitions anew.
    """
    def scan(names: DataFrame, batch: int) -> None:
        names = materialized(names)
        opened = named_files(spark, [r.path for r in names.select("path").collect()], root, language)
        scan_listed(names, out, language, max_bytes, target=root, opened=opened, part=f"/batch={batch}")

    listed = listed_files(spark, root, language, exclude, max_files_per_trigger).select("path", "rel", "length")
    w = listed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(scan)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
