"""JSON documents of any size (S12, S13, O5): a folder whose files, one after another in name order, are one document.

A document is a list of sections: literal text, or the rows of a table as the
elements of an array in a given order.  Each section is a folder of its own;
a table is sorted over the whole cluster and each task writes its range, a line
per element.  No row, task or driver holds more than an element, so a log may
be larger than any of them.  ``hadoop fs -getmerge`` or ``cat`` makes one file of it.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import catalog as C
from vigil.operators import sarif
from vigil.operators.results import LEVELS, finding_fields
from vigil.operators.summary import severity_summary
from vigil.session import materialized


def write_document(spark: SparkSession, out: str, sections: list) -> None:
    """sections: str, or (DataFrame, order columns, JSON column) whose rows become elements with commas between them.

    Tables must be stable (written or checkpointed), as each is read twice: for its first row, and to be written.
    """
    for k, section in enumerate(sections):
        path = f"{out}/{k:02}"
        if isinstance(section, str):
            spark.createDataFrame([(section,)], "text string").coalesce(1).write.text(path)
            continue
        df, order, text = section
        df = df.withColumn("_row", F.monotonically_increasing_id())
        first = df.select(*order, "_row").orderBy(*order, "_row").first()
        if first is None:
            continue
        comma = F.when(F.col("_row") == first["_row"], "").otherwise(",")
        df.orderBy(*order, "_row").select(F.concat(comma, text).alias("text")).write.text(path)


def _json(column: Column) -> Column:
    return F.to_json(column, {"ignoreNullFields": "true"})


def write_sarif(findings: DataFrame, out: str, tool_name: str = C.TOOL_NAME, tool_version: str = C.TOOL_VERSION,
                information_uri: str = C.TOOL_URI) -> None:
    """The log of sarif_log for all findings as one project, of any size; without findings, a run without results."""
    spark = findings.sparkSession
    f = materialized(findings)
    rules = materialized(sarif.sarif_rules(f))
    results = materialized(sarif.sarif_results(f, rules).select("sort_key", _json(sarif.result_object()).alias("o")))
    text = lambda v: json.dumps(v, ensure_ascii=False)
    write_document(spark, out, [
        f'{{"$schema":{text(C.SARIF_SCHEMA)},"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":{text(tool_name)},'
        f'"version":{text(tool_version)},"informationUri":{text(information_uri)},"rules":[',
        (rules, ["rule_index"], _json(sarif.rule_object())),
        ']}},"results":[',
        (results, ["sort_key"], F.col("o")),
        '],"columnKind":"utf16CodeUnits"}]}'])


def write_result_document(findings: DataFrame, out: str, n_files: int | None = None, errors: DataFrame | None = None, target: str = "",
                          mode: str = "standard", language: str = "auto") -> None:
    """The document of result_document for any number of findings and errors; n_files as a scan counted them."""
    spark = findings.sparkSession
    key = F.struct((-F.col("severity_rank")).alias("s"), "path", "detector_ord", "line", "match_ord").alias("sort_key")
    rows = materialized(findings.select(key, "severity", F.to_json(F.struct(*finding_fields(findings.columns))).alias("o")))
    counts = severity_summary(rows).first()  # one row
    summary = {"totalFiles": n_files, "totalIssues": counts["total_issues"], **{s: counts[s] for s in LEVELS}}
    head = {"success": True, "targetPath": target, "mode": mode, "language": language,
            "summary": {k: v for k, v in summary.items() if v is not None}}
    sections = [json.dumps(head, ensure_ascii=False)[:-1] + ',"vulnerabilities":[', (rows, ["sort_key"], F.col("o")), '],"errors":[']
    if errors is not None:
        quoted = F.expr("substr(to_json(array(error)), 2, length(to_json(array(error))) - 2)")
        sections.append((materialized(errors.select("error")), ["error"], quoted))
    write_document(spark, out, [*sections, "]}"])
