"""Result of a scan as JSON (S12): one summary row, finding rows and error rows.

The rows are written as JSON lines; their number has no bound.  ``result_document``
puts a report-sized result into the one nested document of the tool's JSON output.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vigil import catalog as C
from vigil.operators import detect
from vigil.operators.lines import annotate, explode_lines
from vigil.operators.summary import severity_summary
from vigil.sources.files import MAX_FILE_BYTES, contents, listed_files, unscanned

LEVELS = ["critical", "high", "medium", "low", "info"]


def summary_row(findings: DataFrame, lines: DataFrame | None, target: str, mode: str, language: str,
                errors: DataFrame | None = None) -> DataFrame:
    """success, targetPath, mode, language, summary counts and number of errors."""
    counts = severity_summary(findings, lines).select(F.struct(
        F.col("total_files").alias("totalFiles"), F.col("total_issues").alias("totalIssues"), *LEVELS).alias("summary"),
        F.lit(0).cast("long").alias("n"))
    if errors is not None:
        failed = errors.agg(F.lit(None).cast(counts.schema["summary"].dataType).alias("summary"), F.count("*").alias("n"))
        counts = counts.unionByName(failed).agg(F.any_value("summary", True).alias("summary"), F.sum("n").alias("n"))
    return counts.select(F.lit(True).alias("success"), F.lit(target).alias("targetPath"), F.lit(mode).alias("mode"),
                         F.lit(language).alias("language"), "summary", F.col("n").alias("errorCount"))


def finding_fields(columns: list[str]) -> list[Column]:
    """Fields of a finding under the names of the tool's JSON output."""
    out = [F.col(c) for c in ("id", "name", "description", "severity")]
    out += [F.struct(F.col("path").alias("file"), F.col("line")).alias("location"), F.col("rule_id").alias("ruleId"), F.col("cwe"),
            F.col("owasp"), F.col("fix_suggestion").alias("fixSuggestion"), F.col("confidence")]
    if "snippet" in columns:
        s = F.col("snippet")
        out.append(F.struct(s["code"].alias("code"), s["language"].alias("language"), s["start_line"].alias("startLine"),
                            s["highlighted_lines"].alias("highlightedLines")).alias("snippet"))
    return out


def finding_rows(findings: DataFrame) -> DataFrame:
    """One row per finding; absent values are left out when written as JSON."""
    return findings.select(*finding_fields(findings.columns))


def _counters(found: Column) -> list[Column]:
    return [F.count_if(found).alias("total_issues"), *[F.count_if(found & (F.col("severity") == s)).alias(s) for s in LEVELS]]


def _observed(observation: Observation) -> dict:
    """Counts of a finished write; a plan that Spark knew to be empty carries none."""
    got = observation.get or {}
    return {k: got.get(k) or 0 for k in ("total_files", "total_issues", *LEVELS)}


SUMMARY = ("success boolean, targetPath string, mode string, language string, summary struct<totalFiles:bigint,totalIssues:bigint,"
           + ",".join(f"{s}:bigint" for s in LEVELS) + ">, errorCount bigint")


def _counted_summary(spark: SparkSession, counts: dict, n_errors: int, target: str, mode: str, language: str) -> DataFrame:
    return spark.createDataFrame([(True, target, mode, language, (counts["total_files"], counts["total_issues"], *[counts[s] for s in LEVELS]),
                                   n_errors)], SUMMARY)


def write_result(findings: DataFrame, out: str, lines: DataFrame | None = None, errors: DataFrame | None = None,
                 target: str = "", mode: str = "standard", language: str = "auto") -> None:
    """Writes findings/, errors/ and summary/ as JSON lines below ``out``.

    The findings are evaluated once: the write itself counts them.  ``lines``
    are read for the number of files only; scan_tree counts those, too, in its
    one pass.
    """
    seen, failed = Observation(), Observation()
    finding_rows(findings.observe(seen, *_counters(F.col("id").isNotNull()))).write.json(f"{out}/findings")
    counts, n_errors = _observed(seen), 0
    if errors is not None:
        errors.observe(failed, F.count(F.lit(1)).alias("n")).write.json(f"{out}/errors")
        n_errors = (failed.get or {}).get("n") or 0
    counts["total_files"] = lines.agg(F.count_distinct("path")).first()[0] if lines is not None else None
    _counted_summary(findings.sparkSession, counts, n_errors, target, mode, language).coalesce(1).write.json(f"{out}/summary")


# ------------------------------------------------------------- one pass ---
def marked_findings(files: DataFrame, rules: set[str] | None = None, fallback: str = "auto") -> DataFrame:
    """The scan's findings of source_files and one row of each file itself, whose rule_id is null; one narrow pass."""
    d = detect.prepared(annotate(explode_lines(files)))
    found = detect.findings_array(rules, fallback)
    mark = F.when(F.col("line") == 1, F.array(F.lit(None))).otherwise(F.array())  # every file has a first line, if an empty one
    x = d.select("path", "language", "line", F.explode(F.concat(found, mark)).alias("f"))
    return detect.finalize_columns(x.select("path", "language", "line", *[F.col("f." + c).alias(c) for c in detect.FINDING_FIELDS]))


@dataclass
class TreeScan:
    """What one pass over a tree left: tables of findings, scanned files and errors, and their counts."""
    findings: DataFrame
    files: DataFrame
    errors: DataFrame
    counts: dict


def scan_listed(listed: DataFrame, out: str, language: str = "auto", max_bytes: int = MAX_FILE_BYTES, min_severity: str | None = None,
                mode: str = "standard", target: str = "", opened: DataFrame | None = None, part: str = "") -> TreeScan:
    """Scans listed files into ``out``, opening every file once; ``opened`` reads their contents where ``listed`` has none.

    One job writes rows/kind=findings and rows/kind=files and counts them as it
    goes; a file that is listed but left no row could not be read, so the
    errors need the listing's names only.  Existing tables are written anew;
    ``part`` (such as ``/batch=1``) makes them partitions of rows, errors and summary.
    """
    spark = listed.sparkSession
    rows = marked_findings(contents(listed if opened is None else opened, language, max_bytes))
    if min_severity:
        rows = rows.filter(F.col("rule_id").isNull() | (F.col("severity_rank") >= C.SEVERITY_RANK[min_severity]))
    seen, failed = Observation(), Observation()
    found = F.col("rule_id").isNotNull()
    rows = rows.observe(seen, F.count_if(~found).alias("total_files"), *_counters(found))
    rows.withColumn("kind", F.when(found, "findings").otherwise("files")).write.mode("overwrite").partitionBy("kind").parquet(f"{out}/rows{part}")
    table = spark.read.schema(rows.schema.add("kind", "string")).parquet(f"{out}/rows{part}")
    files = table.filter("kind = 'files'").select("path", "language")
    unscanned(listed, files, max_bytes).observe(failed, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/errors{part}")
    errors = spark.read.schema("path string, error string").parquet(f"{out}/errors{part}")
    counts = {**_observed(seen), "errors": (failed.get or {}).get("n") or 0}
    _counted_summary(spark, counts, counts["errors"], target, mode, language).coalesce(1).write.mode("overwrite").json(f"{out}/summary{part}")
    return TreeScan(table.filter("kind = 'findings'").drop("kind"), files, errors, counts)


def scan_tree(spark: SparkSession, root: str, out: str, language: str = "auto", exclude=tuple(C.DEFAULT_EXCLUDE_PATTERNS),
              max_bytes: int = MAX_FILE_BYTES, min_severity: str | None = None) -> TreeScan:
    """A directory tree scanned in one pass: findings, scanned files, errors and summary below ``out``."""
    return scan_listed(listed_files(spark, root, language, exclude), out, language, max_bytes, min_severity, target=root)


def result_document(findings: DataFrame, lines: DataFrame | None = None, errors: DataFrame | None = None, target: str = "",
                    mode: str = "standard", language: str = "auto") -> DataFrame:
    """(json): the whole result as one document, findings in report order; for report-sized results only."""
    key = F.struct((-F.col("severity_rank")).alias("s"), "path", "detector_ord", "line", "match_ord").alias("k")
    head = summary_row(findings, lines, target, mode, language, errors)
    rows = findings.select(key, F.struct(*finding_fields(findings.columns)).alias("v"))
    rows = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("vulnerabilities"))
    failed = head.limit(0).select(F.lit("").alias("error")) if errors is None else errors.select("error")
    failed = failed.agg(F.array_sort(F.collect_list("error")).alias("errors"))
    one = [x.withColumn("_one", F.lit(1)) for x in (head, rows, failed)]
    doc = one[0].join(one[1], "_one").join(one[2], "_one").drop("_one", "errorCount")
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("json"))
