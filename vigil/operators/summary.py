"""Aggregations over findings and lines."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import catalog as C

SUMMARY_COLUMNS = ["total_files", "total_issues", *C.SEVERITY_RANK]


def severity_summary(findings: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One row: total_files, total_issues and one count per severity.

    Both inputs are reduced with partial aggregation; the two one-row results
    are stacked and summed (no join needed).
    """
    counts = findings.agg(
        F.lit(0).cast("long").alias("total_files"),
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITY_RANK])
    if lines is None:
        return counts.withColumn("total_files", F.lit(None).cast("long"))
    files = lines.agg(F.count_distinct("path").alias("total_files"),
                      *[F.lit(0).cast("long").alias(c) for c in SUMMARY_COLUMNS[1:]])
    both = counts.unionByName(files)
    return both.agg(*[F.sum(c).cast("long").alias(c) for c in SUMMARY_COLUMNS])


def owasp_rollup(findings: DataFrame) -> DataFrame:
    """A6 / X5 (extension): findings per OWASP category x severity with subtotals (ROLLUP), category name joined
    from the 10-row literal map."""
    names = F.create_map(*[F.lit(x) for k, (n, _) in C.OWASP_TOP_10_2021.items() for x in (k, n)])
    r = findings.rollup("owasp", "severity").agg(F.count(F.lit(1)).alias("n_findings"),
                                                 F.grouping_id().alias("gid"))
    return r.select("owasp", F.element_at(names, F.col("owasp")).alias("owasp_name"), "severity", "n_findings", "gid")


def rollups(findings: DataFrame) -> DataFrame:
    """Findings per OWASP category, CWE and language, each by severity and in all, per severity, and the total.

    (owasp, cwe, language, severity, n_findings, gid): one pass by grouping
    sets; a column outside of a row's set is null, gid (grouping_id over the
    four, 1 for a column that is left out) tells that from a value that is null.
    """
    by = ["owasp", "cwe", "language", "severity"]
    sets = [s for k in by[:3] for s in ([k, "severity"], [k])] + [["severity"], []]
    return findings.groupingSets(sets, *by).agg(F.count(F.lit(1)).alias("n_findings"), F.grouping_id(*by).cast("long").alias("gid"))


#: What makes a finding the same one in two scans; fallback findings of a line can share an id.
FINDING_KEY = ["rule_id", "path", "line", "match_ord"]


def scan_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """X3 (extension): findings added / fixed between two scans, by their key (anti joins); null parts equal each other."""
    def without(a, b):
        keys = b.select(*[F.col(c).alias("_" + c) for c in FINDING_KEY])
        same = F.lit(True)
        for c in FINDING_KEY:
            same = same & F.col(c).eqNullSafe(F.col("_" + c))
        return a.join(keys, same, "left_anti")
    return without(new, old).withColumn("change", F.lit("added")).unionByName(without(old, new).withColumn("change", F.lit("fixed")))


def owasp_membership(findings: DataFrame) -> DataFrame:
    """Findings per CWE with every OWASP category that lists the CWE, and whether the finding's own is among them."""
    lists = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(c) for c in x])
                           for k, (_, ids) in C.OWASP_TOP_10_2021.items() for x in (k, ids)])
    d = findings.groupBy("owasp", F.nullif(F.regexp_extract("cwe", r"^(CWE-\d+)", 1), F.lit("")).alias("cwe")) \
        .agg(F.count("*").alias("n_findings"))
    every = F.filter(F.map_keys(lists), lambda k: F.coalesce(F.array_contains(F.element_at(lists, k), F.col("cwe")), F.lit(False)))
    return d.select("owasp", "cwe", "n_findings", F.array_join(every, ",").alias("categories"),
                    F.coalesce(F.array_contains(every, F.col("owasp")), F.lit(False)).alias("listed"))
