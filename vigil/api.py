"""Public API: DataFrame in, DataFrame out.

Entry points of the rebuilt tool:
  scan(lines, mode)           full / quick scan -> findings
  severity_summary(findings)  one-row summary
  calls / imports / functions / classes      structural fact tables
  call_graph(lines)           (nodes, edges)
  taint_points(lines)         sources and sinks; taint_candidates joins them inside functions, taint_flows across calls
  file_profile(lines)         per-file structure counts
  check_dependencies(listing) dependency manifests per project root
  rule_scan(files, rules)     rule-pack scan over whole file contents
  with_remediation(findings)  guide lookup: impact, mitigation, references
  sarif(findings)             SARIF result / rule rows; write_sarif a log of any size
  write_result(findings, out) JSON output; scan_tree(spark, root, out) a tree in one pass, with errors and counts
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import detect as _detect
from vigil.operators import lines as _lines
from vigil.operators.documents import write_result_document, write_sarif  # noqa: F401
from vigil.operators.finalize import findings_by_file, sort_findings, top_findings, top_findings_by_file  # noqa: F401
from vigil.operators.remediation import with_remediation  # noqa: F401
from vigil.operators.results import result_document, scan_tree, write_result  # noqa: F401
from vigil.session import materialized
from vigil.sources.corpus import corpus_files, corpus_lines  # noqa: F401
from vigil.sources.files import dependency_manifests as check_dependencies  # noqa: F401
from vigil.sources.tables import table_as_source  # noqa: F401

FINDING_COLUMNS = ["id", "rule_id", "name", "description", "severity", "severity_rank", "path", "language",
                   "line", "cwe", "owasp", "fix_suggestion", "confidence", "detector_ord", "match_ord"]

QUICK_SEVERITIES = ["critical", "high"]
#: Rules that are medium or low whatever the line says: a quick scan need not try them.
ALWAYS_LOWER = {"SQL_INJECTION_RISK", "SSRF_RISK", "PATH_TRAVERSAL_RISK", "HARDCODED_SECRET", "WEAK_CRYPTO",
                "INSECURE_DEPENDENCY", "OPEN_REDIRECT"}


def as_lines(src: DataFrame, context: int | None = None) -> DataFrame:
    """Accept code_lines(path, language, line, text) or source_files(path, language, content).

    With ``context`` the lines carry their snippets.
    """
    from vigil.operators.finalize import line_context
    if "content" in src.columns and "text" not in src.columns:
        return _lines.explode_lines(src, context)
    return src if context is None else line_context(src, context)


def _possible_lines(src: DataFrame, context: int | None, rules: set[str] | None, fallback: str) -> DataFrame:
    """as_lines without the lines that can have no finding; whole files' snippets are cut for the others only."""
    def keep(text, language):
        return _detect.may_match(text, language, rules, fallback)
    if "content" in src.columns and "text" not in src.columns:
        return _lines.explode_lines(src, context, keep)
    return as_lines(src, context).filter(keep(F.col("text"), F.col("language")))


def annotate(src: DataFrame) -> DataFrame:
    return _lines.annotate(as_lines(src))


def fact_lines(src: DataFrame, with_calls: bool = False) -> DataFrame:
    """The lines that structure tables are made of, written once to the checkpoint folder.

    Many as-of branches read them; a lost executor re-reads the checkpoint
    instead of running the regex pass again.  Only headers, decorators,
    braces, calls and file ends are kept, no text of other lines.
    """
    from vigil.operators.facts import fact_lines as _fl
    return materialized(_fl(annotate(src), with_calls))


def scan(src: DataFrame, mode: str = "standard", rules: set[str] | None = None,
         fallback: str = "auto", min_severity: str | None = None, context: int | None = None) -> DataFrame:
    """Findings of the built-in detectors, one per (rule, path, line) (fallback rows excepted).

    mode='quick' keeps critical and high only, and tries no rule that is
    always lower; min_severity keeps rank >= that level; context=k adds the
    snippet of k lines around.  The scan is narrow end to end: no shuffle
    until a sort or aggregate downstream (a line table's snippets excepted).
    """
    from vigil.operators.finalize import filter_min_severity
    if mode == "quick":
        rules = (set(_detect.C.RULE_TEXT) if rules is None else set(rules)) - ALWAYS_LOWER
    lines = _possible_lines(src, context, rules, fallback)
    f = _detect.detect(_lines.annotate(lines), rules, fallback, keep=("snippet",) if context is not None else ())
    if mode == "quick":
        f = f.filter(F.col("severity").isin(*QUICK_SEVERITIES))
    if min_severity:
        f = filter_min_severity(f, min_severity)
    return f


def severity_summary(findings: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    from vigil.operators.summary import severity_summary as _s
    return _s(findings, as_lines(lines) if lines is not None else None)


def scan_summary(src: DataFrame, mode: str = "standard") -> DataFrame:
    """The summary row of a scan in one pass over the source: findings are counted per line and never become rows."""
    rules = set(_detect.C.RULE_TEXT) - ALWAYS_LOWER if mode == "quick" else None
    levels = F.transform(_detect.findings_array(rules), lambda f: f["severity"])
    if mode == "quick":
        levels = F.filter(levels, lambda s: s.isin(*QUICK_SEVERITIES))
    d = _detect.prepared(annotate(src), rules).select("path", levels.alias("_levels"))

    def n(level):
        return F.sum(F.size(F.filter("_levels", lambda s: s == level)).cast("long")).alias(level)
    per_file = d.groupBy("path").agg(F.sum(F.size("_levels").cast("long")).alias("total_issues"), *[n(s) for s in _detect.C.SEVERITY_RANK])
    return per_file.agg(F.count("*").alias("total_files"), *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
                                                             for c in ("total_issues", *_detect.C.SEVERITY_RANK)])


def calls(src: DataFrame) -> DataFrame:
    return _lines.calls_table(annotate(src))


def imports(src: DataFrame) -> DataFrame:
    return _lines.imports_table(annotate(src))


def functions(src: DataFrame, with_params: bool = True) -> DataFrame:
    from vigil.operators.facts import functions_table
    return functions_table(fact_lines(src), with_params)


def classes(src: DataFrame) -> DataFrame:
    from vigil.operators.facts import classes_table
    return classes_table(fact_lines(src))


def variables(src: DataFrame) -> DataFrame:
    from vigil.operators.facts import enums
    return enums(annotate(src))


def call_nodes(src: DataFrame) -> DataFrame:
    from vigil.operators import graph
    return graph.call_nodes(functions(src, with_params=False))


def call_graph(src: DataFrame, language: str | None = None, strict_order: bool = True):
    """(nodes, edges) of the parsed files (optionally one language); edges carry both names."""
    from vigil.operators import facts, graph
    a = fact_lines(src.filter(F.col("language") == language) if language else src, with_calls=True)
    # the function table feeds nodes, caller ranges and definitions: written once
    fns = materialized(facts.functions_table(a, with_params=False))
    edges = graph.call_edges(fns, _lines.calls_table(a.filter(F.size("calls") > 0)), strict_order=strict_order)
    return graph.call_nodes(fns), edges


def reach_layers(edges: DataFrame, starts: DataFrame, max_layers: int | None = None) -> DataFrame:
    """(src, dst, layer) of everything the start functions reach, cycles condensed; see operators.closure."""
    from vigil.operators.closure import reach_layers as _rl
    return _rl(edges, starts, max_layers)


def taint_points(src: DataFrame) -> DataFrame:
    from vigil.operators.taint import taint_points as _tp
    return _tp(as_lines(src))


def taint_candidates(src: DataFrame) -> DataFrame:
    """Sinks with the nearest source above them in the same function."""
    from vigil.operators.taint import taint_candidates as _tc
    return _tc(taint_points(src), functions(src, with_params=False))


def taint_flows(src: DataFrame, strict_order: bool = False, max_hops: int = 10) -> DataFrame:
    """Sinks that a source reaches inside their function or across calls, each with its nearest source."""
    from vigil.operators import facts
    from vigil.operators.flows import read_lines, taint_flows as _tf
    lines, moving = read_lines(annotate(src))
    return _tf(moving, materialized(facts.functions_table(materialized(lines))), strict_order, max_hops)


def call_sinks(src: DataFrame) -> DataFrame:
    from vigil.operators.taint import call_sinks as _cs
    return _cs(calls(src))


def load_rules(path: str | None = None, extra_rules: list | None = None, spark=None):
    from vigil.sources.rulepack import load_rule_pack, validate_patterns
    pack = load_rule_pack(path, extra_rules)
    return validate_patterns(spark, pack) if spark is not None else pack


def rule_scan(files: DataFrame, pack=None) -> DataFrame:
    """Rule-pack findings over source_files(path, language, content); needs whole contents."""
    from vigil.operators.rulescan import rule_scan as _rs
    return _rs(files, pack if pack is not None else load_rules(spark=files.sparkSession))


def rule_match(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of a rules DataFrame of any size: literals pick candidate (file, rule) pairs, regexes run on those."""
    from vigil.operators.rulematch import rule_match as _rm
    return _rm(files, rules)


def listed_calls(src: DataFrame, entries: DataFrame) -> DataFrame:
    """Calls whose name contains an entry(entry, ord[, language]) of a list of any length: the first in list order."""
    from vigil.operators.wordlists import listed_calls as _lc
    return _lc(calls(src), entries)


def snippets(findings: DataFrame, src: DataFrame, context: int = 3) -> DataFrame:
    """Findings of any origin with their snippets; ``scan(context=k)`` gives the scan's own without a join."""
    from vigil.operators.finalize import snippets as _sn
    return _sn(findings, as_lines(src), context)


def sarif(findings: DataFrame):
    """(rules, results) SARIF row tables.  The findings are written once, as both read them."""
    from vigil.operators import sarif as _s
    f = materialized(findings)
    rules = _s.sarif_rules(f)
    return rules, _s.sarif_results(f, rules)


def file_profile(src: DataFrame) -> DataFrame:
    from vigil.operators.profile import file_profile as _fp
    return _fp(annotate(src))
