"""DuckDB oracle SQL for the registered queries.

The SQL is written independently of the Spark plans: calls are unnested and
re-aggregated per line with FILTER/arg_min, facts are joined back by key,
windows are plain per-key windows.  Only the fixed value lists (patterns,
function lists, texts) are shared, since they define the semantics.
Regexes run in RE2 here and in Java regex in Spark.
"""
from __future__ import annotations

from vigil import catalog as C
from vigil.functions.text import TRIM_BOTH, TRIM_START
from vigil.sources.corpus import CALL_TEMPLATES, TEMPLATES


def q(s) -> str:
    if s is None:
        return "NULL"
    return "'" + str(s).replace("'", "''") + "'"


def rx(col: str, pat: str) -> str:
    return f"regexp_matches({col}, {q(pat)})"


def any_rx(col: str, pats) -> str:
    return "(" + " OR ".join(rx(col, p) for p in pats) + ")" if pats else "FALSE"


def any_contains(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(n)})" for n in needles) + ")" if needles else "FALSE"


def corpus_cte() -> str:
    vals = ",\n  ".join(f"({k}, {q(l)}, {q(e)}, {s}, {q(t)})" for k, l, e, s, t in TEMPLATES)
    return f"""
tpl(k, language, ext, slot, template) AS (VALUES
  {vals}),
ev AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
code_lines AS (
  SELECT 'src/u' || CAST(user_id AS VARCHAR) || '.' || ext AS path, language, CAST(rn AS INTEGER) AS line,
         replace(replace(replace(template, '{{id}}', CAST(event_id AS VARCHAR)), '{{u}}', CAST(user_id AS VARCHAR)),
                 '{{b}}', CAST((rn - 1) // 10 AS VARCHAR)) AS text
  FROM ev JOIN tpl ON user_id % 6 = k AND (rn - 1) % 10 = slot)"""


def call_corpus_cte() -> str:
    """call_lines(path, language, line, text) of the files that call each other."""
    vals = ", ".join(f"({k}, {q(t)})" for k, t in CALL_TEMPLATES)
    n = len(CALL_TEMPLATES)
    text = "template"
    for key, value in (("id", "event_id"), ("u", "user_id"), ("b", f"(rn - 1) // {n}"), ("p", "user_id // 2"),
                       ("n", "user_id // 8 * 8 + (user_id + 1) % 8"), ("call", "CASE WHEN user_id % 2 = 0 THEN 'get' ELSE 'relay' END")):
        text = f"replace({text}, '{{{key}}}', CAST({value} AS VARCHAR))"
    return f"""
call_tpl(slot, template) AS (VALUES {vals}),
call_lines AS (
  SELECT 'calls/u' || user_id || '.py' AS path, 'python' AS language, CAST(rn AS INTEGER) AS line, {text} AS text
  FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
  JOIN call_tpl ON (rn - 1) % {n} = slot)"""


def both_corpora() -> list[str]:
    """code_lines: the line corpus and the files that call each other."""
    return [corpus_cte().replace("code_lines AS (", "plain_lines AS ("), call_corpus_cte(),
            "code_lines AS (SELECT path, language, line, text FROM plain_lines UNION ALL SELECT path, language, line, text FROM call_lines)"]


def file_cte() -> str:
    """files(path, language, content): templates by doc_id, then the document's text."""
    from vigil.sources.corpus import FILE_TEMPLATES
    n = len(FILE_TEMPLATES)
    pick = lambda f: f"CASE doc_id % {n} " + " ".join(f"WHEN {t[0]} THEN {q(f(t))}" for t in FILE_TEMPLATES) + " END"
    head = pick(lambda t: "\n".join(t[3]) + "\n")
    return f"""
files AS (SELECT 'doc/d' || CAST(doc_id AS VARCHAR) || '.' || {pick(lambda t: t[2])} AS path, {pick(lambda t: t[1])} AS language,
                 replace({head}, '{{id}}', CAST(doc_id AS VARCHAR)) || coalesce(text, '') AS content FROM documents)"""


def file_lines_cte() -> str:
    return file_cte() + """,
code_lines AS (
  SELECT path, language, CAST(u.i AS INTEGER) AS line, u.piece AS text
  FROM files, LATERAL (SELECT unnest(string_split(content, chr(10))) AS piece,
                              unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i) u)"""


def table_lines_cte(name: str, table: str, key: str, text: str, prefix: str, language: str, ext: str) -> str:
    """code_lines of a text table (path = prefix/key.ext), split on newline, 1-based."""
    return f"""
{name} AS (
  SELECT '{prefix}/' || CAST({key} AS VARCHAR) || '.{ext}' AS path, {q(language)} AS language,
         CAST(u.i AS INTEGER) AS line, u.piece AS text
  FROM (SELECT {key}, coalesce({text}, '') AS content FROM {table}) s,
       LATERAL (SELECT unnest(string_split(content, chr(10))) AS piece,
                       unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i) u)"""


def kind_expr() -> str:
    t = "trimmed"
    py = f"""CASE WHEN {t} = '' OR starts_with({t}, '#') THEN 'skip'
      WHEN starts_with({t}, '@') THEN 'decorator'
      WHEN {rx(t, C.PY_CLASS)} THEN 'class'
      WHEN {rx(t, C.PY_FUNCTION)} THEN 'function'
      WHEN {rx(t, C.PY_IMPORT)} THEN 'import'
      WHEN {rx(t, C.PY_FROM_IMPORT)} THEN 'from_import' ELSE 'other' END"""
    js = f"""CASE WHEN {t} = '' OR starts_with({t}, '//') OR starts_with({t}, '/*') THEN 'skip'
      WHEN {rx(t, C.JS_CLASS)} THEN 'class'
      WHEN {rx(t, C.JS_FUNCTION)} THEN 'function'
      WHEN {rx(t, C.JS_ARROW)} THEN 'arrow'
      WHEN {rx(t, C.JS_IMPORT_ES6)} THEN 'import'
      WHEN {rx(t, C.JS_REQUIRE)} THEN 'require' ELSE 'other' END"""
    go = f"""CASE WHEN {t} = '' OR starts_with({t}, '//') THEN 'skip'
      WHEN {rx(t, C.GO_FUNCTION)} THEN 'function'
      WHEN {rx(t, C.GO_STRUCT)} THEN 'struct'
      WHEN {rx(t, C.GO_INTERFACE)} THEN 'interface'
      WHEN starts_with({t}, 'import') THEN 'import' ELSE 'other' END"""
    jm = f"({rx(t, C.JAVA_METHOD)} AND NOT contains({t}, 'new ') AND NOT contains({t}, 'return '))"
    skipnames = ", ".join(q(x) for x in C.JAVA_METHOD_SKIP_NAMES)
    java = f"""CASE WHEN {t} = '' OR starts_with({t}, '//') OR starts_with({t}, '/*') THEN 'skip'
      WHEN starts_with({t}, '@') AND {rx(t, C.JAVA_ANNOTATION)} THEN 'annotation'
      WHEN {rx(t, C.JAVA_CLASS)} THEN 'class'
      WHEN {rx(t, C.JAVA_INTERFACE)} THEN 'interface'
      WHEN {jm} AND regexp_extract({t}, {q(C.JAVA_METHOD)}, 2) IN ({skipnames}) THEN 'skip'
      WHEN {jm} THEN 'method'
      WHEN {rx(t, C.JAVA_IMPORT)} THEN 'import' ELSE 'other' END"""
    php = f"""CASE WHEN {t} = '' OR starts_with({t}, '//') OR starts_with({t}, '#') OR starts_with({t}, '/*') THEN 'skip'
      WHEN {rx(t, C.PHP_CLASS)} THEN 'class'
      WHEN {rx(t, C.PHP_FUNCTION)} THEN 'function'
      WHEN {rx(t, C.PHP_USE)} THEN 'import' ELSE 'other' END"""
    return f"""CASE WHEN language = 'python' THEN {py}
    WHEN language IN ('javascript', 'typescript') THEN {js}
    WHEN language = 'go' THEN {go}
    WHEN language = 'java' THEN {java}
    WHEN language = 'php' THEN {php}
    ELSE 'unparsed' END"""


def annotated_cte(src: str = "code_lines") -> str:
    return f"""
trimmed_lines AS (
  SELECT path, language, line, text, regexp_replace(text, {q(TRIM_BOTH)}, '', 'g') AS trimmed,
         CAST(length(text) - length(regexp_replace(text, {q(TRIM_START)}, '')) AS INTEGER) AS indent
  FROM {src}),
annotated AS (SELECT *, {kind_expr()} AS kind FROM trimmed_lines)"""


def calls_cte() -> str:
    def kw(lang_cond, names, prefix=False):
        if not names:
            return None
        if prefix:
            return "(" + " OR ".join(f"starts_with(name, {q(n)})" for n in names) + ")"
        return f"name IN ({', '.join(q(n) for n in names)})"
    skip = f"""CASE WHEN language IN ('javascript', 'typescript') THEN {kw(None, C.CALL_KEYWORDS['javascript'])}
      WHEN language = 'go' THEN {kw(None, C.CALL_KEYWORDS['go'])}
      WHEN language = 'php' THEN {kw(None, C.CALL_KEYWORDS['php'])}
      WHEN language = 'java' THEN {kw(None, C.CALL_KEYWORDS['java'], prefix=True)}
      ELSE FALSE END"""
    return f"""
call_matches AS (
  SELECT path, language, line, trimmed,
         CASE WHEN language = 'php' THEN regexp_extract_all(trimmed, {q(C.PHP_CALL_PATTERN)}, 1)
              ELSE regexp_extract_all(trimmed, {q(C.CALL_PATTERN)}, 1) END AS names,
         CASE WHEN language = 'php' THEN regexp_extract_all(trimmed, {q(C.PHP_CALL_PATTERN)}, 2)
              ELSE regexp_extract_all(trimmed, {q(C.CALL_PATTERN)}, 2) END AS argss
  FROM annotated WHERE kind = 'other'),
call_rows AS (
  SELECT path, language, line, trimmed, unnest(names) AS name, unnest(argss) AS args,
         CAST(unnest(range(len(names))) AS INTEGER) AS ord
  FROM call_matches),
calls AS (SELECT * FROM call_rows WHERE NOT ({skip}))"""


def _lang_case(table: dict, build, default="FALSE") -> str:
    parts = []
    for lang in C.PARSED_LANGUAGES:
        parts.append(f"WHEN language = {q(lang)} THEN {build(table.get(lang, []))}")
    return "CASE " + " ".join(parts) + f" ELSE {default} END"


def _first_entry(vals) -> str:
    if not vals:
        return "NULL"
    return "CASE " + " ".join(f"WHEN contains(name, {q(v)}) THEN {q(v)}" for v in vals) + " ELSE NULL END"


def user_input_expr(col: str = "text") -> str:
    def build(pats):
        if not pats:
            return "FALSE"
        return rx(col, "(?i)" + "|".join("(?:%s)" % p.replace("(?i)", "", 1) for p in pats))
    return _lang_case(C.USER_INPUT_SOURCES, build)


def imports_cte() -> str:
    t = "trimmed"
    g = lambda p, i: f"regexp_extract({t}, {q(p)}, {i})"
    es6_named_src = f"coalesce(nullif({g(C.JS_IMPORT_ES6, 1)}, ''), nullif({g(C.JS_IMPORT_ES6, 3)}, ''))"
    ws = r"\s+as\s+"
    return f"""
imp_py AS (
  SELECT path, language, line, 0 AS import_ord, {g(C.PY_IMPORT, 1)} AS name, {g(C.PY_IMPORT, 1)} AS "from",
         nullif({g(C.PY_IMPORT, 2)}, '') AS alias, FALSE AS is_default, TRUE AS is_namespace
  FROM annotated WHERE language = 'python' AND kind = 'import'),
imp_pyfrom_parts AS (
  SELECT path, language, line, {g(C.PY_FROM_IMPORT, 1)} AS modname,
         unnest(string_split({g(C.PY_FROM_IMPORT, 2)}, ',')) AS part,
         unnest(range(len(string_split({g(C.PY_FROM_IMPORT, 2)}, ',')))) AS import_ord
  FROM annotated WHERE language = 'python' AND kind = 'from_import'),
imp_pyfrom AS (
  SELECT path, language, line, CAST(import_ord AS INTEGER) AS import_ord,
         regexp_replace(string_split_regex(regexp_replace(part, {q(TRIM_BOTH)}, '', 'g'), {q(ws)})[1], {q(TRIM_BOTH)}, '', 'g') AS name,
         modname AS "from",
         regexp_replace(string_split_regex(regexp_replace(part, {q(TRIM_BOTH)}, '', 'g'), {q(ws)})[2], {q(TRIM_BOTH)}, '', 'g') AS alias,
         FALSE AS is_default, FALSE AS is_namespace
  FROM imp_pyfrom_parts),
imp_es6_default AS (
  SELECT path, language, line, {g(C.JS_IMPORT_ES6, 2)} AS name, {g(C.JS_IMPORT_ES6, 4)} AS "from"
  FROM annotated WHERE language IN ('javascript', 'typescript') AND kind = 'import' AND {g(C.JS_IMPORT_ES6, 2)} <> ''),
imp_es6_named_parts AS (
  SELECT path, language, line, {g(C.JS_IMPORT_ES6, 4)} AS modname, unnest(string_split({es6_named_src}, ',')) AS part,
         unnest(range(len(string_split({es6_named_src}, ',')))) AS k,
         CASE WHEN {g(C.JS_IMPORT_ES6, 2)} <> '' THEN 1 ELSE 0 END AS base
  FROM annotated WHERE language IN ('javascript', 'typescript') AND kind = 'import' AND {es6_named_src} IS NOT NULL),
imp_es6_named_split AS (
  SELECT path, language, line, modname, k, base,
         string_split_regex(regexp_replace(part, {q(TRIM_BOTH)}, '', 'g'), {q(ws)}) AS pieces
  FROM imp_es6_named_parts),
imp_es6_named AS (
  SELECT path, language, line, modname, base, pieces,
         CAST(row_number() OVER (PARTITION BY path, line ORDER BY k) - 1 AS INTEGER) AS r
  FROM imp_es6_named_split WHERE regexp_replace(pieces[1], {q(TRIM_BOTH)}, '', 'g') <> ''),
imp_js AS (
  SELECT path, language, line, 0 AS import_ord, name, "from", CAST(NULL AS VARCHAR) AS alias, TRUE AS is_default, FALSE AS is_namespace
  FROM imp_es6_default
  UNION ALL
  SELECT path, language, line, base + r AS import_ord, regexp_replace(pieces[1], {q(TRIM_BOTH)}, '', 'g') AS name,
         modname AS "from", regexp_replace(pieces[2], {q(TRIM_BOTH)}, '', 'g') AS alias, FALSE, FALSE
  FROM imp_es6_named
  UNION ALL
  SELECT path, language, line, 0, {g(C.JS_REQUIRE, 1)}, {g(C.JS_REQUIRE, 1)}, NULL, FALSE, TRUE
  FROM annotated WHERE language IN ('javascript', 'typescript') AND kind = 'require'),
imp_other AS (
  SELECT path, language, line, 0 AS import_ord, {g(C.GO_IMPORT, 2)} AS name, {g(C.GO_IMPORT, 2)} AS "from",
         CAST(NULL AS VARCHAR) AS alias, FALSE AS is_default, TRUE AS is_namespace
  FROM annotated WHERE language = 'go' AND kind = 'import' AND {g(C.GO_IMPORT, 2)} <> ''
  UNION ALL
  SELECT path, language, line, 0,
         CASE WHEN string_split({g(C.JAVA_IMPORT, 1)}, '.')[-1] <> '' THEN string_split({g(C.JAVA_IMPORT, 1)}, '.')[-1]
              ELSE {g(C.JAVA_IMPORT, 1)} END,
         {g(C.JAVA_IMPORT, 1)}, NULL, FALSE, FALSE
  FROM annotated WHERE language = 'java' AND kind = 'import'
  UNION ALL
  SELECT path, language, line, 0,
         coalesce(nullif({g(C.PHP_USE, 2)}, ''),
                  CASE WHEN string_split({g(C.PHP_USE, 1)}, chr(92))[-1] <> '' THEN string_split({g(C.PHP_USE, 1)}, chr(92))[-1]
                       ELSE {g(C.PHP_USE, 1)} END),
         {g(C.PHP_USE, 1)}, nullif({g(C.PHP_USE, 2)}, ''), FALSE, FALSE
  FROM annotated WHERE language = 'php' AND kind = 'import'),
imports AS (
  SELECT * FROM imp_py UNION ALL SELECT * FROM imp_pyfrom UNION ALL SELECT * FROM imp_js UNION ALL SELECT * FROM imp_other)"""


def _cwe(cwe):
    return q(f"{cwe}: {C.CWE_NAMES.get(cwe, '')}") if cwe else "CAST(NULL AS VARCHAR)"


def _finding_select(rule, sev, fix, desc=None, conf=0.8, match_ord="0", src="L", where="TRUE"):
    name, d, cwe, owasp = C.RULE_TEXT[rule]
    return (f"SELECT path, language, line, {q(rule)} AS rule_id, {q(name)} AS name, "
            f"{desc if desc else q(d)} AS description, {sev} AS severity, {_cwe(cwe)} AS cwe, "
            f"{q(owasp) if owasp else 'CAST(NULL AS VARCHAR)'} AS owasp, {fix} AS fix_suggestion, "
            f"CAST({conf} AS DOUBLE) AS confidence, {C.DETECTOR_ORDER[rule]} AS detector_ord, "
            f"CAST({match_ord} AS INTEGER) AS match_ord FROM {src} WHERE {where}")


def _map_case(d: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN language = {q(k)} THEN {q(v)}" for k, v in d.items()) + f" ELSE {q(default)} END"


def findings_cte(rules=None, fallback="auto") -> str:
    """findings of the built-in detectors over ``annotated`` (+ calls, imports)."""
    want = (lambda r: True) if rules is None else (lambda r: r in rules)
    parsed = "language IN (" + ", ".join(q(x) for x in C.PARSED_LANGUAGES) + ")"
    sql_line = any_rx("text", C.SQL_INJECTION_PATTERNS)
    dang = _lang_case(C.DANGEROUS_FUNCTIONS, lambda v: any_contains("name", v) if v else "FALSE")
    deser = _lang_case(C.DESERIALIZATION_FUNCTIONS, lambda v: any_contains("name", v) if v else "FALSE")
    entry = _lang_case(C.DANGEROUS_FUNCTIONS, _first_entry, "NULL")
    pk = _lang_case(C.INSECURE_PACKAGES,
                    lambda v: "(" + " OR ".join(f"contains(\"from\", {q(p)}) OR name = {q(p)}" for p in v) + ")"
                    if v else "FALSE")
    crit = " OR ".join(f"contains(entry, {q(c)})" for c in C.DANGER_CRITICAL)
    high = " OR ".join(f"contains(entry, {q(c)})" for c in C.DANGER_HIGH)
    fix_sql = _map_case(C.FIX_SQL, C.FIX_SQL_DEFAULT)
    fix_deser = _map_case(C.FIX_DESER, C.FIX_DESER_DEFAULT)
    cte = f"""
L AS (SELECT *, {user_input_expr()} AS ui, {sql_line} AS sql_line FROM annotated WHERE {parsed}),
call_flags AS (
  SELECT c.path, c.language, c.line, c.name, c.ord,
         {any_contains('lower(c.name)', C.SQL_CALL_NAMES)} AS f_sql,
         {dang} AS f_dang, {deser} AS f_deser, {entry} AS entry,
         {any_contains('c.name', C.URL_CALL_NAMES)} AS f_url,
         {any_contains('lower(c.name)', C.FILE_CALL_NAMES)} AS f_file
  FROM calls c),
per_line_calls AS (
  SELECT path, line,
    min(ord) FILTER (WHERE f_sql) AS sql_ord,
    min(ord) FILTER (WHERE f_dang) AS dang_ord, arg_min(name, ord) FILTER (WHERE f_dang) AS dang_name,
    min(ord) FILTER (WHERE f_deser) AS deser_ord, arg_min(name, ord) FILTER (WHERE f_deser) AS deser_name,
    min(ord) FILTER (WHERE f_url) AS url_ord, min(ord) FILTER (WHERE f_file) AS file_ord,
    min(ord) FILTER (WHERE entry IS NOT NULL) AS ent_ord,
    arg_min(name, ord) FILTER (WHERE entry IS NOT NULL) AS ent_name,
    arg_min(entry, ord) FILTER (WHERE entry IS NOT NULL) AS entry
  FROM call_flags GROUP BY path, line),
imp_flags AS (
  SELECT i.path, i.line, i.import_ord, i."from", {pk} AS hit FROM imports i),
per_line_imports AS (
  SELECT path, line, arg_min("from", import_ord) FILTER (WHERE hit) AS dep_from
  FROM imp_flags GROUP BY path, line),
LC AS (SELECT L.*, p.*, i.dep_from FROM L LEFT JOIN per_line_calls p USING (path, line)
       LEFT JOIN per_line_imports i USING (path, line)),
raw_findings AS ("""
    parts = []
    if want("SQL_INJECTION"):
        parts.append(_finding_select("SQL_INJECTION", "'high'", fix_sql, src="LC", where="sql_line"))
    if want("SQL_INJECTION_RISK"):
        parts.append(_finding_select("SQL_INJECTION_RISK", "'medium'", fix_sql, match_ord="sql_ord", src="LC",
                                     where=f"NOT sql_line AND sql_ord IS NOT NULL AND {any_contains('text', C.SQL_RISK_LINE_MARKERS)}"))
    if want("COMMAND_INJECTION"):
        desc = ("'检测到潜在的系统命令执行函数 \"' || dang_name || '\"。' || CASE WHEN ui THEN "
                f"{q(C.COMMAND_INPUT_TEXT[0])} ELSE {q(C.COMMAND_INPUT_TEXT[1])} END")
        parts.append(_finding_select("COMMAND_INJECTION", "CASE WHEN ui THEN 'critical' ELSE 'high' END",
                                     q(C.FIX_COMMAND), desc, match_ord="dang_ord", src="LC",
                                     where="dang_ord IS NOT NULL"))
    for rule, pats, sev, fix in [("XSS", C.XSS_PATTERNS, "high", C.FIX_XSS), ("SSRF", C.SSRF_PATTERNS, "high", C.FIX_SSRF)]:
        if want(rule):
            parts.append(_finding_select(rule, q(sev), q(fix), src="LC", where=any_rx("text", pats)))
    if want("SSRF_RISK"):
        parts.append(_finding_select("SSRF_RISK", "'medium'", q(C.FIX_SSRF), match_ord="url_ord", src="LC",
                                     where="url_ord IS NOT NULL AND ui"))
    if want("PATH_TRAVERSAL"):
        parts.append(_finding_select("PATH_TRAVERSAL", "'high'", q(C.FIX_PATH), src="LC",
                                     where=any_rx("text", C.PATH_TRAVERSAL_PATTERNS)))
    if want("PATH_TRAVERSAL_RISK"):
        parts.append(_finding_select("PATH_TRAVERSAL_RISK", "'medium'", q(C.FIX_PATH), match_ord="file_ord",
                                     src="LC", where="file_ord IS NOT NULL AND ui"))
    if want("HARDCODED_SECRET"):
        parts.append(_finding_select("HARDCODED_SECRET", "'medium'", q(C.FIX_SECRET), src="LC",
                                     where=any_rx("text", C.SENSITIVE_DATA_PATTERNS)))
    if want("WEAK_CRYPTO"):
        parts.append(_finding_select("WEAK_CRYPTO", "'medium'", q(C.FIX_CRYPTO), src="LC",
                                     where=any_rx("text", C.WEAK_CRYPTO_PATTERNS)))
    if want("DESERIALIZATION"):
        desc = "'检测到不安全的反序列化函数 \"' || deser_name || '\"。可能导致远程代码执行。'"
        parts.append(_finding_select("DESERIALIZATION", "'critical'", fix_deser, desc, match_ord="deser_ord",
                                     src="LC", where="deser_ord IS NOT NULL"))
    if want("DANGEROUS_FUNCTION"):
        desc = "'检测到危险函数 \"' || ent_name || '\" 的调用。请确保输入经过严格验证和清理。'"
        sev = f"CASE WHEN {crit} THEN 'critical' WHEN {high} THEN 'high' ELSE 'medium' END"
        parts.append(_finding_select("DANGEROUS_FUNCTION", sev, q(C.FIX_DANGEROUS), desc, match_ord="ent_ord",
                                     src="LC", where="ent_ord IS NOT NULL"))
    if want("INSECURE_DEPENDENCY"):
        desc = "'检测到引入可能存在安全风险的依赖 \"' || dep_from || '\"。'"
        parts.append(_finding_select("INSECURE_DEPENDENCY", "'low'", q(C.FIX_DEPENDENCY), desc, conf=0.6,
                                     src="LC", where="dep_from IS NOT NULL"))
    if want("XXE"):
        parts.append(_finding_select("XXE", "'high'", q(C.FIX_XXE), src="LC", where=any_rx("text", C.XXE_PATTERNS)))
    if want("OPEN_REDIRECT"):
        parts.append(_finding_select("OPEN_REDIRECT", "'medium'", q(C.FIX_REDIRECT), src="LC",
                                     where=any_rx("text", C.OPEN_REDIRECT_PATTERNS)))
    fb_where = {"auto": f"NOT ({parsed})", "only": "TRUE", "off": "FALSE"}[fallback]
    if fallback == "only":
        parts = []
    for k, (pat, name, sev, desc) in enumerate(C.FALLBACK_PATTERNS):
        parts.append(
            f"SELECT path, language, line, 'PATTERN_MATCH' AS rule_id, {q(name)} AS name, {q(desc)} AS description, {q(sev)} AS severity, "
            f"CAST(NULL AS VARCHAR) AS cwe, CAST(NULL AS VARCHAR) AS owasp, CAST(NULL AS VARCHAR) AS fix_suggestion, "
            f"CAST(0.7 AS DOUBLE) AS confidence, {C.DETECTOR_ORDER['PATTERN_MATCH']} AS detector_ord, "
            f"{k} AS match_ord FROM annotated WHERE {fb_where} AND {rx('text', pat)}")
    cte += "\n  UNION ALL\n  ".join(parts) + "),"
    sev_rank = "CASE severity " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in C.SEVERITY_RANK.items()) + " ELSE 0 END"
    cte += f"""
findings AS (
  SELECT CASE WHEN rule_id = 'PATTERN_MATCH'
              THEN lower(regexp_replace(name || '_' || path || '_' || CAST(line AS VARCHAR), '\\s+', '_', 'g'))
              ELSE substr(md5(rule_id || ':' || path || ':' || CAST(line AS VARCHAR)), 1, 12) END AS id,
         *, {sev_rank} AS severity_rank
  FROM raw_findings)"""
    return cte


FINDING_COLS = ("id, rule_id, name, description, severity, severity_rank, path, language, line, cwe, owasp, "
                "fix_suggestion, confidence, detector_ord, match_ord")


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes)


# ----------------------------------------------------------------- facts ---
def _params_sql(col: str, lang: str, kind: str) -> str:
    """Parameter list as text (name|type|default|optional|variadic; '-' for none), per language."""
    trim = lambda x: f"regexp_replace({x}, {q(TRIM_BOTH)}, '', 'g')"
    parts = lambda c: f"list_transform(string_split({c}, ','), lambda x: {trim('x')})"
    g = lambda p, i: f"regexp_extract(x, {q(p)}, {i})"
    opt = lambda p, i: f"coalesce({trim(f'nullif({g(p, i)}, {q('')})')}, '-')"

    def each(src, keep, *fields):
        kept = f"list_filter({src}, lambda x: {keep})"
        return f"array_to_string(list_transform({kept}, lambda x: {' || chr(124) || '.join(fields)}), ';')"
    yes = lambda c: f"CASE WHEN {c} THEN 'true' ELSE 'false' END"
    none = "'-'"
    py = each(parts(col), f"x <> '' AND x NOT IN ('self', 'cls') AND {rx('x', C.PY_PARAM)}", g(C.PY_PARAM, 1), opt(C.PY_PARAM, 2),
              opt(C.PY_PARAM, 3), yes(f"{g(C.PY_PARAM, 3)} <> ''"), yes("starts_with(x, '*')"))
    js = each(parts(col), "TRUE", trim("string_split(x, '=')[1]"), none, f"coalesce({trim('string_split(x, chr(61))[2]')}, '-')",
              yes("coalesce(string_split(x, '=')[2] <> '', FALSE)"), none)
    # commas inside one level of angle brackets are set aside while splitting
    aside = f"regexp_replace({col}, '<([^<>,]*),([^<>]*)>', '<' || chr(92) || '1' || chr(1) || chr(92) || '2>', 'g')"
    ts_parts = f"list_transform(string_split({aside}, ','), lambda x: replace({trim('x')}, chr(1), ','))"
    ts = each(ts_parts, f"x <> '' AND {rx('x', C.TS_PARAM)}", g(C.TS_PARAM, 2), opt(C.TS_PARAM, 4), opt(C.TS_PARAM, 5),
              yes(f"{g(C.TS_PARAM, 3)} <> '' OR {g(C.TS_PARAM, 5)} <> ''"), yes(f"{g(C.TS_PARAM, 1)} <> ''"))
    go = each(parts(col), f"x <> '' AND {rx('x', C.GO_PARAM)}", g(C.GO_PARAM, 1), opt(C.GO_PARAM, 2), none, none, none)
    java = each(parts(col), f"x <> '' AND {rx('x', C.JAVA_PARAM)}", g(C.JAVA_PARAM, 2), f"replace({g(C.JAVA_PARAM, 1)}, '...', '[]')",
                none, none, yes(f"contains({g(C.JAVA_PARAM, 1)}, '...')"))
    php = each(parts(col), f"x <> '' AND {rx('x', C.PHP_PARAM)}", g(C.PHP_PARAM, 2), f"coalesce(nullif({g(C.PHP_PARAM, 1)}, ''), '-')",
               opt(C.PHP_PARAM, 3), yes(f"{g(C.PHP_PARAM, 3)} <> ''"), none)
    return f"""coalesce(CASE WHEN {trim(col)} = '' THEN '' WHEN {lang} = 'python' THEN {py} WHEN {lang} = 'javascript' THEN {js}
      WHEN {lang} = 'typescript' THEN {ts} WHEN {lang} = 'go' THEN {go} WHEN {lang} = 'java' THEN {java} ELSE {php} END, '')"""


def _names_sql(expr: str, drop_empty: bool) -> str:
    """'A, B' -> list of trimmed names."""
    parts = f"list_transform(string_split({expr}, ','), lambda x: regexp_replace(x, {q(TRIM_BOTH)}, '', 'g'))"
    return f"list_filter({parts}, lambda x: x <> '')" if drop_empty else parts


def facts_cte() -> str:
    """fn_rows, class_rows, end lines, class context, decorators -> functions_f, classes_f."""
    t = "trimmed"
    g = lambda p, i: f"regexp_extract({t}, {q(p)}, {i})"
    is_fn = ("((language = 'python' AND kind = 'function') OR (language IN ('javascript','typescript') AND kind IN ('function','arrow'))"
             " OR (language = 'go' AND kind = 'function') OR (language = 'java' AND kind = 'method') OR (language = 'php' AND kind = 'function'))")
    is_cls = ("(language IN ('python','javascript','typescript','go','java','php') AND (kind = 'class' OR (language = 'go' AND kind IN ('struct','interface'))"
              " OR (language = 'java' AND kind = 'interface')))")
    return f"""
fn_rows AS (
  SELECT path, language, line, indent, kind, trimmed,
    CASE WHEN language = 'python' THEN {g(C.PY_FUNCTION, 1)}
         WHEN language IN ('javascript','typescript') AND kind = 'function' THEN {g(C.JS_FUNCTION, 1)}
         WHEN language IN ('javascript','typescript') THEN {g(C.JS_ARROW, 1)}
         WHEN language = 'go' THEN {g(C.GO_FUNCTION, 3)}
         WHEN language = 'java' THEN {g(C.JAVA_METHOD, 2)}
         ELSE {g(C.PHP_FUNCTION, 1)} END AS name,
    CASE WHEN language = 'python' THEN {g(C.PY_FUNCTION, 2)}
         WHEN language IN ('javascript','typescript') AND kind = 'function' THEN {g(C.JS_FUNCTION, 2)}
         WHEN language IN ('javascript','typescript') THEN ''
         WHEN language = 'go' THEN {g(C.GO_FUNCTION, 4)}
         WHEN language = 'java' THEN {g(C.JAVA_METHOD, 3)}
         ELSE {g(C.PHP_FUNCTION, 2)} END AS params,
    CASE WHEN language = 'python' THEN nullif({g(C.PY_FUNCTION, 3)}, '') WHEN language = 'go' THEN nullif({g(C.GO_FUNCTION, 5)}, '')
         WHEN language = 'java' THEN {g(C.JAVA_METHOD, 1)} END AS return_type,
    CASE WHEN language = 'python' THEN contains({g(C.PY_FUNCTION, 0)}, 'async ')
         WHEN language IN ('javascript','typescript') THEN contains(trimmed, 'async ') END AS is_async
  FROM annotated WHERE {is_fn}),
class_rows AS (
  SELECT path, language, line, indent, kind,
    CASE WHEN kind IN ('struct','interface') THEN kind ELSE 'class' END AS class_kind,
    CASE WHEN language = 'python' THEN {g(C.PY_CLASS, 1)}
         WHEN language IN ('javascript','typescript') THEN {g(C.JS_CLASS, 1)}
         WHEN language = 'go' AND kind = 'struct' THEN {g(C.GO_STRUCT, 1)}
         WHEN language = 'go' THEN {g(C.GO_INTERFACE, 1)}
         WHEN language = 'java' AND kind = 'class' THEN {g(C.JAVA_CLASS, 1)}
         WHEN language = 'java' THEN {g(C.JAVA_INTERFACE, 1)}
         ELSE {g(C.PHP_CLASS, 1)} END AS name,
    CASE WHEN language = 'python' THEN {_names_sql(g(C.PY_CLASS, 2), True)}[1]
         WHEN language IN ('javascript','typescript') THEN nullif({g(C.JS_CLASS, 2)}, '')
         WHEN language = 'java' AND kind = 'class' THEN nullif({g(C.JAVA_CLASS, 2)}, '')
         WHEN language = 'php' THEN nullif({g(C.PHP_CLASS, 2)}, '') END AS parent_class,
    CASE WHEN language = 'python' THEN coalesce(array_to_string({_names_sql(g(C.PY_CLASS, 2), True)}[2:], ','), '')
         WHEN language = 'java' AND kind = 'class' THEN array_to_string({_names_sql(f"nullif({g(C.JAVA_CLASS, 3)}, '')", False)}, ',')
         WHEN language = 'java' THEN array_to_string({_names_sql(f"nullif({g(C.JAVA_INTERFACE, 2)}, '')", False)}, ',')
         WHEN language = 'php' THEN array_to_string({_names_sql(f"nullif({g(C.PHP_CLASS, 3)}, '')", False)}, ',') END AS interfaces
  FROM annotated WHERE {is_cls}),
heads AS (SELECT path, language, line, indent FROM fn_rows UNION SELECT path, language, line, indent FROM class_rows),
n_lines AS (SELECT path, max(line) AS n FROM annotated GROUP BY path),
py_cand AS (
  SELECT path, line, indent FROM annotated
  WHERE language = 'python' AND trimmed <> '' AND NOT starts_with(trimmed, '#')
    AND (starts_with(trimmed, 'def ') OR starts_with(trimmed, 'async def ') OR starts_with(trimmed, 'class '))),
py_end AS (
  SELECT h.path, h.line, (SELECT min(c.line) FROM py_cand c WHERE c.path = h.path AND c.line > h.line AND c.indent <= h.indent) - 1 AS end_line
  FROM heads h WHERE h.language = 'python'),
brace_ev AS (
  SELECT path, line, i, CASE WHEN ch = '{{' THEN 1 ELSE -1 END AS delta FROM (
    SELECT path, line, unnest(regexp_extract_all(text, '[{{}}]')) AS ch,
           unnest(range(len(regexp_extract_all(text, '[{{}}]')))) AS i
    FROM annotated WHERE language IN ('javascript','typescript','go','java','php'))),
brace_depth AS (
  SELECT *, sum(delta) OVER (PARTITION BY path ORDER BY line, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth
  FROM brace_ev),
brace_heads AS (
  SELECT h.path, h.line,
         coalesce((SELECT sum(delta) FROM brace_ev e WHERE e.path = h.path AND e.line < h.line), 0) AS d0
  FROM heads h WHERE h.language <> 'python'),
brace_end AS (
  SELECT b.path, b.line,
         (SELECT min(d.line) FROM brace_depth d WHERE d.path = b.path AND d.line >= b.line AND d.delta = -1 AND d.depth = b.d0) AS end_line
  FROM brace_heads b),
end_lines AS (SELECT * FROM py_end UNION ALL SELECT * FROM brace_end),
cls_heads AS (
  SELECT path, line AS cline,
         CASE WHEN language = 'python' THEN {g(C.PY_CLASS, 1)} WHEN language = 'java' THEN {g(C.JAVA_CLASS, 1)}
              ELSE {g(C.PHP_CLASS, 1)} END AS cname
  FROM annotated WHERE language IN ('python','java','php') AND kind = 'class'),
dec_rows AS (
  SELECT path, line, CASE WHEN language = 'python' THEN {g(C.PY_DECORATOR, 1)} ELSE {g(C.JAVA_ANNOTATION, 1)} END AS dname
  FROM annotated
  WHERE (language = 'python' AND kind = 'decorator' AND {rx(t, C.PY_DECORATOR)}) OR (language = 'java' AND kind = 'annotation')),
consumers AS (
  SELECT path, line AS cl FROM annotated
  WHERE (language = 'python' AND kind IN ('class','function')) OR (language = 'java' AND kind IN ('class','method'))),
dec_att AS (SELECT d.path, d.line, d.dname, c.cl FROM dec_rows d ASOF JOIN consumers c ON d.path = c.path AND d.line < c.cl),
decs AS (SELECT path, cl AS line, list(dname ORDER BY line) AS decorators FROM dec_att GROUP BY path, cl),
functions_f AS (
  SELECT substr(sha256('func:' || f.path || ':' || CAST(f.line AS VARCHAR)), 1, 16) AS fn_id,
         f.path, f.language, f.name, f.line, coalesce(e.end_line, n.n) AS end_line, f.return_type, f.is_async,
         {_params_sql('f.params', 'f.language', 'f.kind')} AS parameters,
         CASE WHEN f.language IN ('python','php') THEN ch.cname IS NOT NULL
              WHEN f.language = 'go' THEN {g(C.GO_FUNCTION, 2).replace('trimmed', 'f.trimmed')} <> ''
              WHEN f.language = 'java' THEN TRUE ELSE FALSE END AS is_method,
         CASE WHEN f.language IN ('python','php','java') THEN ch.cname
              WHEN f.language = 'go' THEN nullif({g(C.GO_FUNCTION, 2).replace('trimmed', 'f.trimmed')}, '') END AS class_name,
         CASE WHEN f.language = 'python' THEN coalesce(list_contains(dd.decorators, 'export'), FALSE) OR starts_with(f.name, 'test_')
              WHEN f.language IN ('javascript','typescript') AND f.kind = 'function' THEN starts_with(f.trimmed, 'export')
              WHEN f.language = 'go' THEN substr(f.name, 1, 1) = upper(substr(f.name, 1, 1))
              WHEN f.language = 'java' THEN contains(f.trimmed, 'public')
              WHEN f.language = 'php' THEN starts_with(f.name, '__') OR contains(f.trimmed, 'public') END AS is_exported,
         CASE WHEN f.language = 'python' AND f.indent > 0 THEN ch.cline WHEN f.language IN ('java','php') THEN ch.cline END AS method_of_line,
         CASE WHEN f.language = 'python' THEN dd.decorators END AS decorators
  FROM fn_rows f
  LEFT JOIN end_lines e ON e.path = f.path AND e.line = f.line
  LEFT JOIN n_lines n ON n.path = f.path
  ASOF LEFT JOIN cls_heads ch ON ch.path = f.path AND ch.cline < f.line
  LEFT JOIN decs dd ON dd.path = f.path AND dd.line = f.line),
classes_f AS (
  SELECT substr(sha256('class:' || c.class_kind || ':' || c.path || ':' || CAST(c.line AS VARCHAR)), 1, 16) AS class_id,
         c.path, c.language, c.class_kind AS kind, c.name, c.line, coalesce(e.end_line, n.n) AS end_line,
         c.parent_class, c.interfaces, dd.decorators
  FROM class_rows c
  LEFT JOIN end_lines e ON e.path = c.path AND e.line = c.line
  LEFT JOIN n_lines n ON n.path = c.path
  LEFT JOIN decs dd ON dd.path = c.path AND dd.line = c.line
  UNION ALL
  SELECT substr(sha256('class:interface:' || path || ':' || CAST(line AS VARCHAR)), 1, 16), path, language, 'interface',
         {g(C.TS_INTERFACE, 1)}, line, line, nullif({g(C.TS_INTERFACE, 2)}, ''), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR[])
  FROM annotated WHERE language = 'typescript' AND {rx(t, C.TS_INTERFACE)})"""


def graph_cte(strict: bool = True) -> str:
    return """
call_pts AS (SELECT DISTINCT path, line FROM calls),
callers AS (
  SELECT p.path, p.line, arg_min(f.fn_id, f.line) AS caller_id
  FROM call_pts p JOIN functions_f f ON f.path = p.path AND f.line <= p.line AND p.line <= f.end_line
  GROUP BY p.path, p.line),
last_def AS (SELECT language, name, path, arg_max(fn_id, line) AS callee_id FROM functions_f GROUP BY language, name, path),
call_keys AS (SELECT DISTINCT language, name, path FROM calls),
callee AS (
  SELECT k.language, k.name, k.path, arg_max(d.callee_id, d.path) AS to_id
  FROM call_keys k JOIN last_def d ON d.language = k.language AND d.name = k.name {ORDER}
  GROUP BY k.language, k.name, k.path),
calls_n AS (SELECT *, CAST(row_number() OVER (PARTITION BY path, line ORDER BY ord) - 1 AS INTEGER) AS call_ord FROM calls),
edges AS (
  SELECT cr.caller_id AS from_id, ce.to_id, c.path, c.language, c.line, c.call_ord
  FROM calls_n c JOIN callers cr ON cr.path = c.path AND cr.line = c.line
  JOIN callee ce ON ce.language = c.language AND ce.name = c.name AND ce.path = c.path)""".replace("{ORDER}", "AND d.path <= k.path" if strict else "")
