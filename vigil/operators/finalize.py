"""Finding post-processing: dedup (W1), severity filters (P5, P6), ordering (T1), top-k (T2), snippets (P13), groups (A3, T5)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import catalog as C

SORT_COLUMNS = ["severity_rank", "path", "detector_ord", "line", "match_ord"]
ASCENDING = [False, True, True, True, True]
#: What tells findings apart; ids alone may repeat among fallback findings of one line.
FINDING_KEY = ["rule_id", "path", "line", "match_ord"]
#: Lines of a block of the snippet window.
CONTEXT_BLOCK = 4096


def dedup_findings(findings: DataFrame) -> DataFrame:
    """First finding per (rule_id, path, line) by (detector_ord, match_ord).

    Needed only for unions with findings from other sources: built-in line
    detectors are deduplicated inside the line row already.  The window key is
    the finding key itself, so groups are tiny and spread evenly.
    """
    w = Window.partitionBy("rule_id", "path", "line").orderBy("detector_ord", "match_ord")
    return findings.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def filter_min_severity(findings: DataFrame, min_severity: str) -> DataFrame:
    return findings.filter(F.col("severity_rank") >= F.lit(C.SEVERITY_RANK[min_severity]))


def sort_findings(findings: DataFrame) -> DataFrame:
    """Severity descending; ties keep file, detector and emission order."""
    return findings.orderBy(*SORT_COLUMNS, ascending=ASCENDING)


def top_findings(findings: DataFrame, k: int = 100) -> DataFrame:
    """The first k findings of the sorted list (TakeOrderedAndProject, no full sort)."""
    return findings.orderBy(*SORT_COLUMNS, ascending=ASCENDING).limit(k)


def _sort_struct() -> Column:
    return F.struct((-F.col("severity_rank")).alias("_s"), "detector_ord", "line", "match_ord", "rule_id")


def top_findings_by_file(findings: DataFrame, k: int = 20) -> DataFrame:
    """The first k findings of every file in report order.

    Two steps, so that one file with very many findings is not one window
    partition: first inside pieces of a file, then over at most k per piece.
    """
    piece = F.floor(F.col("line") / F.lit(CONTEXT_BLOCK))
    order = _sort_struct()
    inner = Window.partitionBy("path", "_piece").orderBy("_order")
    outer = Window.partitionBy("path").orderBy("_order")
    d = findings.withColumn("_piece", piece).withColumn("_order", order)
    d = d.withColumn("_rn", F.row_number().over(inner)).filter(F.col("_rn") <= k)
    return d.withColumn("file_rank", F.row_number().over(outer)).filter(F.col("file_rank") <= k).drop("_rn", "_piece", "_order")


def findings_by_file(findings: DataFrame) -> DataFrame:
    """A3: per file the number of findings, the number per severity and the worst severity rank.

    The findings themselves stay rows, as one file's list has no bound; a
    table partitioned or sorted by path serves as the grouped list.
    """
    return findings.groupBy("path").agg(
        F.count("*").alias("n_findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITY_RANK],
        F.max("severity_rank").alias("max_severity_rank"))


def chunked(findings: DataFrame, size: int) -> DataFrame:
    """T5: rows of every file in chunks of ``size``, numbered from 0 within the file (``chunk``), in report order.

    Positions come from blocked running counts, so a hot file is split.
    """
    from vigil.plans.prefix import running
    d = findings.withColumn("_one", F.lit(1))
    order = ["line", "detector_ord", "match_ord", "rule_id"]
    d = running(d, ["path"], order, F.floor(F.col("line") / F.lit(CONTEXT_BLOCK)), F.col("_one"), "_n", how="sum")
    return d.withColumn("chunk", F.floor((F.col("_n") - 1) / F.lit(size)).cast("int")).drop("_one", "_n")


def line_context(lines: DataFrame, context: int = 3) -> DataFrame:
    """Lines of a code_lines table with ``snippet``: the lines [max(1, l-k), min(n, l+k)] around each.

    Files are cut into blocks of lines; a block also gets the k lines beyond
    its edges, so a long file is split and no line's neighbours are missing.
    """
    at = F.floor(F.col("line") / F.lit(CONTEXT_BLOCK))
    near = F.array_distinct(F.array(F.floor((F.col("line") - context) / F.lit(CONTEXT_BLOCK)), at,
                                    F.floor((F.col("line") + context) / F.lit(CONTEXT_BLOCK))))
    d = lines.withColumn("_own", at).withColumn("_block", F.explode(near))
    w = Window.partitionBy("path", "_block").orderBy("line").rangeBetween(-context, context)
    code = F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), "\n")
    first = F.min("line").over(w)
    d = d.withColumn("snippet", snippet_struct(code, F.col("language"), first, F.col("line")))
    return d.filter("_block = _own").drop("_own", "_block")


def snippet_struct(code: Column, language: Column, start_line: Column, line: Column) -> Column:
    return F.struct(code.alias("code"), language.alias("language"), start_line.cast("int").alias("start_line"),
                    F.array(line.cast("int")).alias("highlighted_lines"))


def snippets(findings: DataFrame, lines: DataFrame, context: int = 3) -> DataFrame:
    """Findings with their ``snippet``; one join on the line, whatever ids the findings share."""
    around = line_context(lines, context).select("path", "line", "snippet")
    return findings.drop("snippet").join(around, ["path", "line"])


def line_content(lines: DataFrame, at: DataFrame) -> DataFrame:
    """(path, line) rows with the text of that line, '' where the file has no such line."""
    text = lines.select("path", "line", "text")
    return at.join(text, ["path", "line"], "left").withColumn("text", F.coalesce("text", F.lit("")))
