"""SARIF 2.1.0 output (O1-O5, S13) as DataFrames.

sarif_rules: one row per rule in order of first appearance (W9 dense index).
sarif_results: one row per finding (scales with the findings).
sarif_log: one JSON document per project; a document holds its project's
results in one row, so projects must be report-sized; the row tables and
documents.write_sarif have no such bound.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import catalog as C
from vigil.functions.ids import sarif_fingerprint
from vigil.functions.severity import sarif_level

ATTRIBUTES = ["name", "description", "severity", "cwe", "owasp", "fix_suggestion", "tags"]


def _with_tags(findings: DataFrame) -> DataFrame:
    return findings if "tags" in findings.columns else findings.withColumn("tags", F.lit(None).cast("array<string>"))


def sarif_rules(findings: DataFrame, by: tuple = ()) -> DataFrame:
    """Unique rules with the attributes of their first finding in report order, plus rule_index (per ``by`` group)."""
    key = F.struct(-F.col("severity_rank"), F.col("path"), F.col("detector_ord"), F.col("line"), F.col("match_ord"))
    first = _with_tags(findings).groupBy(*by, "rule_id").agg(F.min(key).alias("_k"), F.min_by(F.struct(*ATTRIBUTES), key).alias("r"))
    # one row per rule id: the window runs over the aggregated rules only
    idx = F.row_number().over(Window.partitionBy(*by).orderBy("_k") if by else Window.orderBy("_k")) - 1
    r = F.col("r")
    return first.select(
        *by, "rule_id", idx.alias("rule_index"), r["name"].alias("name"), r["description"].alias("short_description"),
        sarif_level(r["severity"]).alias("level"), r["severity"].alias("severity"), r["cwe"].alias("cwe"),
        r["owasp"].alias("owasp"), r["fix_suggestion"].alias("help"),
        F.when(r["cwe"].isNotNull(), F.concat(F.lit("https://cwe.mitre.org/data/definitions/"),
                                               F.regexp_extract(r["cwe"], r"CWE-(\d+)", 1), F.lit(".html"))).alias("help_uri"),
        r["tags"].alias("tags"))


def sarif_results(findings: DataFrame, rules: DataFrame | None = None, by: tuple = ()) -> DataFrame:
    """One SARIF result row per finding, whatever ids findings share.

    ``snippet`` is the code of the findings' snippet column where they have
    one; ``sort_key`` is the report order.
    """
    rules = rules if rules is not None else sarif_rules(findings, by)
    f = findings.join(rules.select(*by, "rule_id", "rule_index"), [*by, "rule_id"], "left")
    code = F.col("snippet")["code"] if "snippet" in findings.columns else F.lit(None).cast("string")
    column = F.coalesce(F.col("column"), F.lit(1)) if "column" in findings.columns else F.lit(1)
    return f.select(
        *by, "id", "rule_id", "rule_index", sarif_level(F.col("severity")).alias("level"),
        F.col("description").alias("message"), F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("uri"),
        F.col("line").alias("start_line"), column.alias("start_column"), F.col("line").alias("end_line"),
        F.lit(1).alias("end_column"), code.alias("snippet"),
        sarif_fingerprint(F.col("path"), F.col("line"), F.col("rule_id")).alias("fingerprint"), "confidence",
        F.struct((-F.col("severity_rank")).alias("severity"), "path", "detector_ord", "line", "match_ord").alias("sort_key"))


def rule_object() -> Column:
    def text(c):
        return F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(F.col(c).alias("text")))
    return F.struct(
        F.col("rule_id").alias("id"), F.col("name"), F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
        F.struct("level").alias("defaultConfiguration"), text("help").alias("help"), F.col("help_uri").alias("helpUri"),
        F.struct("severity", F.when(F.col("cwe").isNotNull(), F.array("cwe")).alias("cwe"),
                 F.when(F.col("owasp").isNotNull(), F.array("owasp")).alias("owasp"),
                 F.when(F.size("tags") > 0, F.col("tags")).alias("tags")).alias("properties"))


def result_object() -> Column:
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"),
                      F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"),
                      F.when(F.col("snippet") != "", F.struct(F.col("snippet").alias("text"))).alias("snippet"))
    place = F.struct(F.struct(F.col("uri")).alias("artifactLocation"), region.alias("region"))
    return F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), F.col("level"),
                    F.struct(F.col("message").alias("text")).alias("message"),
                    F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
                    F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("partialFingerprints"),
                    F.struct("confidence").alias("properties"))


def sarif_log(findings: DataFrame, project: Column | None = None, tool_name: str = C.TOOL_NAME,
              tool_version: str = C.TOOL_VERSION, information_uri: str = C.TOOL_URI) -> DataFrame:
    """(project, sarif): one SARIF log as JSON per project, results in report order.

    ``project`` is a column of the findings, by default all are one project
    ('').  No finding gives no row.
    """
    by = ("project",)
    f = findings.withColumn("project", project if project is not None else F.lit(""))
    rules = sarif_rules(f, by)
    rr = sarif_results(f, rules, by).groupBy(*by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("sort_key", result_object().alias("o")))), lambda x: x["o"]).alias("results"))
    rl = rules.groupBy(*by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rule_index", rule_object().alias("o")))), lambda x: x["o"]).alias("rules"))
    driver = F.struct(F.lit(tool_name).alias("name"), F.lit(tool_version).alias("version"),
                      F.lit(information_uri).alias("informationUri"), F.col("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"), F.lit("utf16CodeUnits").alias("columnKind"))
    log = F.struct(F.lit(C.SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return rr.join(rl, list(by)).select("project", F.to_json(log, {"ignoreNullFields": "true"}).alias("sarif"))
