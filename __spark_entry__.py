"""

``entry(spark)`` runs the flagship query (full scan of the templated code
corpus) on sf0.001; ``queries()`` registers one callable per implemented
operator; ``oracle_sql()`` gives the DuckDB SQL of each, written independently
in ``duckdb_oracle``.  All queries read the given tables (or data Spark derives
from them) in full.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from duckdb_oracle import queries as OQ  # noqa: E402
from vigil import api  # noqa: E402
from vigil import catalog as C  # noqa: E402
from vigil.functions import paths, text  # noqa: E402
from vigil.operators import finalize, graph, profile, results, summary  # noqa: E402
from vigil.operators.closure import strong_components  # noqa: E402
from vigil.sources.corpus import call_lines  # noqa: E402
from vigil.sources.rulepack import rules_dataframe  # noqa: E402

try:  # this subpackage and the pipeline may be absent; their own import errors still show
    import vigil.llm  # noqa: F401
except ModuleNotFoundError as e:
    if e.name != "vigil.llm":
        raise
    LLM_QUERIES, LLM_SQL = {}, {}
else:
    import corpus_pipeline
    from vigil.llm.queries import QUERIES as LLM_QUERIES
    from vigil.llm.sql import ORACLE_SQL as LLM_SQL
    LLM_QUERIES = {**LLM_QUERIES, "pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL:
        LLM_SQL = {**LLM_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entry(spark: SparkSession) -> DataFrame:
    return api.sort_findings(q_scan_findings(spark, "/root/testdata/sf0.001"))


# ---------------------------------------------------------------- corpus ---
def _corpus(spark, sf_dir):
    return api.corpus_lines(_t(spark, sf_dir, "events"))


def _calling(spark, sf_dir):
    return call_lines(_t(spark, sf_dir, "events"))


def _files(spark, sf_dir):
    return api.corpus_files(_t(spark, sf_dir, "documents"))


def q_corpus_lines(spark, sf_dir):
    return _corpus(spark, sf_dir)


def q_scan_findings(spark, sf_dir):
    return api.scan(_corpus(spark, sf_dir)).select(*api.FINDING_COLUMNS)


def q_quick_scan(spark, sf_dir):
    return api.scan(_corpus(spark, sf_dir), mode="quick").select(*api.FINDING_COLUMNS)


def q_min_severity_scan(spark, sf_dir):
    return api.scan(_corpus(spark, sf_dir), min_severity="high").select(*api.FINDING_COLUMNS)


def q_severity_summary(spark, sf_dir):
    return api.scan_summary(_corpus(spark, sf_dir))


def q_calls(spark, sf_dir):
    return api.calls(_corpus(spark, sf_dir))


def q_imports(spark, sf_dir):
    return api.imports(_corpus(spark, sf_dir))


def _param_text(p):
    """A parameter list as one text: name|type|default|optional|variadic, '-' where there is none."""
    return F.array_join(F.transform(p, lambda x: F.concat_ws("|", *[
        F.coalesce(x[c].cast("string"), F.lit("-")) for c in ("name", "type", "default_value", "is_optional", "is_variadic")])), ";")


def _function_columns(f):
    return f.withColumn("parameters", _param_text("parameters"))


def _class_columns(c):
    return c.withColumn("interfaces", F.array_join("interfaces", ","))


def q_functions(spark, sf_dir):
    return _function_columns(api.functions(_corpus(spark, sf_dir)))


def q_classes(spark, sf_dir):
    return _class_columns(api.classes(_corpus(spark, sf_dir)))


def q_file_functions(spark, sf_dir):
    return _function_columns(api.functions(_files(spark, sf_dir)))


def q_file_classes(spark, sf_dir):
    return _class_columns(api.classes(_files(spark, sf_dir)))


def q_enums(spark, sf_dir):
    return api.variables(_corpus(spark, sf_dir))


def q_call_nodes(spark, sf_dir):
    return api.call_nodes(_corpus(spark, sf_dir))


def q_call_edges(spark, sf_dir):
    return api.call_graph(_corpus(spark, sf_dir))[1]


def _graph_and_starts(spark, sf_dir):
    """Call graph of both corpora, names resolved over the whole of it; starts: all functions of users divisible by 100."""
    nodes, edges = api.call_graph(_corpus(spark, sf_dir).unionByName(_calling(spark, sf_dir)), strict_order=False)
    user = F.regexp_extract("file", r"/u(\d+)\.", 1).cast("long")
    return edges, nodes.filter(user % 100 == 0).select(F.col("node_id").alias("src"))


def q_reachable(spark, sf_dir):
    """What the functions of users divisible by 100 reach within 10 calls, with the fewest calls."""
    return graph.reachable(*_graph_and_starts(spark, sf_dir))


def q_reach_layers(spark, sf_dir):
    """Everything that the functions of users divisible by 100 reach, over strongly connected components."""
    return api.reach_layers(*_graph_and_starts(spark, sf_dir))


def q_strong_components(spark, sf_dir):
    """Component of every function on a call edge."""
    edges, _ = _graph_and_starts(spark, sf_dir)
    return strong_components(edges)


def q_graph_counts(spark, sf_dir):
    lines = _corpus(spark, sf_dir)
    nodes, edges = api.call_graph(lines)
    points = api.taint_points(lines)
    return graph.counts(nodes=nodes, edges=edges, sources=points.filter("kind = 'source'"), sinks=points.filter("kind = 'sink'"))


def q_first_functions(spark, sf_dir):
    return profile.first_functions(api.functions(_corpus(spark, sf_dir), with_params=False), 20).select("path", "line", "name")


# -------------------------------------------------- whole files, tables ---
USER_RULES = [
    {"id": "USER_TOKEN", "name": "token literal", "description": "user rule: token assigned a literal", "category": "secrets",
     "severity": "HIGH", "languages": ["*"], "cwe": "CWE-798", "owasp": "A07:2021", "tags": ["secrets"],
     "patterns": [{"pattern": r"""(?i)token\s*[=:]\s*["'][^"']+["']"""}]},
    {"id": "USER_ANCHORED", "name": "closing line", "description": "user rule: a line that is one brace", "category": "style",
     "severity": "info", "languages": ["go", "java", "php", "rust"], "cwe": "CWE-1", "owasp": "A00:2021",
     "patterns": [r"^\}$"]},
]


def q_rule_scan_files(spark, sf_dir):
    pack = api.load_rules(extra_rules=USER_RULES, spark=spark)
    pack.config = {**pack.config, "minSeverity": "info"}
    return api.rule_scan(_files(spark, sf_dir), pack)


def q_rule_scan_documents(spark, sf_dir):
    docs = api.table_as_source(_t(spark, sf_dir, "documents"), "doc_id", "text", "doc", "python", "txt")
    return api.rule_scan(docs, api.load_rules(extra_rules=USER_RULES, spark=spark))


def _event_rules(spark, sf_dir):
    """The default pack's rules and one per user of the events, as a DataFrame: assignments of that user's names."""
    pack = api.load_rules(extra_rules=USER_RULES, spark=spark)
    users = _t(spark, sf_dir, "events").select("user_id").distinct()
    uid = F.col("user_id").cast("string")
    made = users.select(
        (F.col("user_id") + 1000).cast("int").alias("load_ord"), F.concat(F.lit("USER_"), uid).alias("rule_id"), F.lit("user rule").alias("name"),
        F.lit("a name of the user").alias("description"), F.lit("names").alias("category"), F.element_at(
            F.array(F.lit("low"), F.lit("HIGH"), F.lit("odd")), (F.col("user_id") % 3 + 1).cast("int")).alias("severity"),
        F.when(F.col("user_id") % 2 == 0, F.array(F.lit("python"), F.lit("go"))).otherwise(F.array(F.lit("*"))).alias("languages"),
        F.lit("CWE-1").alias("cwe"), F.lit("A00:2021").alias("owasp"), F.array(F.lit("names")).alias("tags"),
        F.array(F.concat(F.lit(r"(?i)passw[o0]rd\s*=\s*.[a-z]"), uid, F.lit(r"\b")),
                F.concat(F.lit("(?:cb|func f|interface [JR])"), uid, F.lit(r"\b"))).alias("patterns"),
        F.lit("").alias("fix_suggestion"))
    return rules_dataframe(spark, pack).unionByName(made)


def q_rule_match_files(spark, sf_dir):
    """A rules DataFrame that grows with the events, over whole files."""
    return api.rule_match(_files(spark, sf_dir), _event_rules(spark, sf_dir))


def q_listed_calls(spark, sf_dir):
    """Call names against a list with an entry per event: names of handlers, some for one language only."""
    ev = _t(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    entries = ev.select(F.concat(F.lit("h"), user, F.lit("_"), (F.col("event_id") % 9).cast("string")).alias("entry"), F.col("event_id").alias("ord"),
                        F.when(F.col("event_id") % 2 == 0, "javascript").alias("language"))
    fixed = spark.createDataFrame([("exec", 10 ** 12, None), ("get", 10 ** 12 + 1, None), ("", 10 ** 12 + 2, "php")], "entry string, ord long, language string")
    return api.listed_calls(_corpus(spark, sf_dir), entries.unionByName(fixed))


def q_scan_files(spark, sf_dir):
    return api.scan(_files(spark, sf_dir)).select(*api.FINDING_COLUMNS)


def q_fallback_files(spark, sf_dir):
    """The fallback detector on every line of the whole-file corpus, with snippets."""
    f = api.scan(_files(spark, sf_dir), fallback="only", context=3)
    return f.select(*api.FINDING_COLUMNS, F.col("snippet.code").alias("code"), F.col("snippet.start_line").alias("start_line"))


def q_file_imports(spark, sf_dir):
    return api.imports(_files(spark, sf_dir))


def q_pages_lines(spark, sf_dir):
    pages = api.table_as_source(_t(spark, sf_dir, "pages"), "page_id", "html", "page", "javascript", "html")
    return api.calls(pages)


def q_conversation_profile(spark, sf_dir):
    conv = _t(spark, sf_dir, "conversations")
    src = api.table_as_source(conv, F.concat_ws("_", "conv_id", "turn"), "text", "conv", "python", "py")
    return api.file_profile(src)


def q_path_facts(spark, sf_dir):
    """Path and text helpers over the pages' addresses and texts."""
    url = F.col("url")
    return _t(spark, sf_dir, "pages").select(
        "page_id", paths.extension(url).alias("ext"), paths.detect_language(url).alias("language"),
        paths.is_supported(url).alias("supported"), paths.valid_target(url).alias("valid"),
        paths.relative_path(url, "https://").alias("below"), paths.normalize_path(F.concat(F.lit("a\\"), url)).alias("normal"),
        paths.simple_excluded(url, ["**/a*", "org"]).alias("simply_excluded"), paths.excluded(url, ["**/*e/**"]).alias("excluded"),
        text.truncate(F.col("html"), 40).alias("short"), text.escape_html(text.truncate(F.col("html"), 60)).alias("escaped"),
        text.escape_markdown(url).alias("markdown"), text.format_duration(F.col("page_id") * 970).alias("duration"))


# -------------------------------------------------------- taint, results ---
def q_taint_points(spark, sf_dir):
    return api.taint_points(_corpus(spark, sf_dir))


def q_taint_candidates(spark, sf_dir):
    return api.taint_candidates(_corpus(spark, sf_dir))


def q_taint_flows(spark, sf_dir):
    """Flows across functions and files: the line corpus and the corpus of files that call each other."""
    return api.taint_flows(_corpus(spark, sf_dir).unionByName(_calling(spark, sf_dir)))


def q_call_sinks(spark, sf_dir):
    return api.call_sinks(_corpus(spark, sf_dir))


def _with_snippet_fields(f):
    return f.select("id", "rule_id", "path", "line", "match_ord", F.col("snippet.code").alias("code"),
                    F.col("snippet.language").alias("language"), F.col("snippet.start_line").alias("start_line"),
                    F.col("snippet.highlighted_lines")[0].alias("highlighted_line"))


def q_finding_snippets(spark, sf_dir):
    return _with_snippet_fields(api.scan(_corpus(spark, sf_dir), context=3))


def q_sarif_results(spark, sf_dir):
    return api.sarif(api.scan(_corpus(spark, sf_dir), context=3))[1].drop("sort_key")


def q_sarif_rules(spark, sf_dir):
    return api.sarif(api.scan(_corpus(spark, sf_dir)))[0].drop("tags")


def q_result_rows(spark, sf_dir):
    """The JSON output's finding rows."""
    f = results.finding_rows(api.scan(_corpus(spark, sf_dir)))
    return f.select("id", "name", "description", "severity", F.col("location.file").alias("file"), F.col("location.line").alias("line"),
                    "ruleId", "cwe", "owasp", "fixSuggestion", "confidence")


def q_result_summary(spark, sf_dir):
    lines = _corpus(spark, sf_dir)
    r = results.summary_row(api.scan(lines), lines, "events", "standard", "auto")
    return r.select("success", "targetPath", "mode", "language", "summary.*", "errorCount")


def q_remediation(spark, sf_dir):
    f = api.with_remediation(api.scan(_corpus(spark, sf_dir)))
    return f.select("id", "rule_id", *[c for c in f.columns if c.startswith("remediation_")])


def q_findings_by_file(spark, sf_dir):
    return api.findings_by_file(api.scan(_corpus(spark, sf_dir)))


def q_top_by_file(spark, sf_dir):
    return api.top_findings_by_file(api.scan(_corpus(spark, sf_dir)), 20).select("path", "file_rank", "id")


def q_top_findings(spark, sf_dir):
    return api.top_findings(api.scan(_corpus(spark, sf_dir)), 100).select("id", "severity", "path", "line")


def q_finding_chunks(spark, sf_dir):
    return finalize.chunked(api.scan(_corpus(spark, sf_dir)), 10).select("id", "path", "chunk")


def q_scan_diff(spark, sf_dir):
    """Full scan against quick scan: what the quick one leaves out."""
    lines = _corpus(spark, sf_dir)
    d = summary.scan_diff(api.scan(lines).select(*api.FINDING_COLUMNS), api.scan(lines, mode="quick").select(*api.FINDING_COLUMNS))
    return d.select("id", "rule_id", "path", "line", "change")


def q_manifests(spark, sf_dir):
    """Manifest check over a listing drawn from all events: a root per user, four of the ten names in each, some without any manifest."""
    ev = _t(spark, sf_dir, "events")
    names = F.array(*[F.lit(x) for x in (*C.DEPENDENCY_FILES, "main.py", "README.md")])
    name = F.get(names, ((F.col("user_id") * 7 + F.col("event_id") % 4 * (F.col("user_id") % 3)) % 10).cast("int"))
    root = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return api.check_dependencies(ev.select(F.concat(root, F.lit("/"), name).alias("path")), roots=ev.select(root.alias("root")))


def q_file_profile(spark, sf_dir):
    return api.file_profile(_corpus(spark, sf_dir))


def q_owasp_rollup(spark, sf_dir):
    return summary.owasp_rollup(api.scan(_corpus(spark, sf_dir)))


def q_rollups(spark, sf_dir):
    return summary.rollups(api.scan(_corpus(spark, sf_dir)))


#: An exclusion list of braces, classes, a group and a pattern that takes back.
PAGE_GLOBS = ["**/{fr,de}/*[0-9]", "**/*.@(html|htm)", "!**/*[!3-9].html", "http*/**/en/[1-4]{0..9}"]


def q_page_globs(spark, sf_dir):
    """Exclusion lists over the pages' addresses, without their scheme and query."""
    url = F.regexp_replace("url", r"[?#].*$", "")
    return _t(spark, sf_dir, "pages").select("page_id", paths.excluded(url, PAGE_GLOBS).alias("excluded"),
                                             paths.excluded(url, PAGE_GLOBS[:2]).alias("first_two"))


def q_owasp_membership(spark, sf_dir):
    return summary.owasp_membership(api.scan(_corpus(spark, sf_dir)))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: f for name, f in list(globals().items()) if name.startswith("q_") and callable(f)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query (views region ... conversations pre-registered)."""
    return {k: v for k, v in {**OQ.all_sql(), **LLM_SQL}.items() if k in queries()}
