"""Built-in detectors as one row-local pass over annotated lines.

Each detector yields at most one finding per (rule, line) once duplicates are
removed, and the kept finding is the first one in emission order (the first
call on the line, the first list entry).  Both are decided inside the line
row with array functions, so the whole scan is narrow: lines -> array of
finding structs -> explode.  The fallback detector (languages without fact
rules) may report several findings per line, as it never deduplicates.
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import catalog as C
from vigil.functions.ids import fallback_id, finding_id
from vigil.functions.memo import per_session
from vigil.functions.severity import danger_level, severity_rank




FINDING_FIELDS = ["rule_id", "name", "description", "severity", "cwe", "owasp", "fix_suggestion",
                  "confidence", "detector_ord", "match_ord"]


def LANG():
    return F.col("language")

def TEXT():
    return F.col("text")


def _or(cs):
    cs = list(cs)
    return reduce(lambda a, b: a | b, cs) if cs else F.lit(False)


def alternation(patterns) -> str:
    """One regex for a list; a flag such as (?i) holds inside its own group only."""
    return "|".join(f"(?:{p})" for p in patterns)


def any_rlike(c: Column, patterns) -> Column:
    return c.rlike(alternation(patterns)) if patterns else F.lit(False)


def any_name_contains(needles) -> Column:
    """Cheap test of a line: does any of its call names contain a needle?  The names are read as one text."""
    return F.col("_names").rlike("|".join(re.escape(n) for n in needles)) if needles else F.lit(False)


def any_contains(c: Column, needles) -> Column:
    return _or(c.contains(n) for n in needles)


def by_language(table: dict, build, default=None) -> Column:
    """when(language == l, build(table[l])) over the parsed languages."""
    out = None
    for lang in C.PARSED_LANGUAGES:
        vals = table.get(lang, [])
        e = build(vals)
        out = F.when(LANG() == lang, e) if out is None else out.when(LANG() == lang, e)
    return out.otherwise(default if default is not None else F.lit(None))


def cwe_label(cwe: str | None) -> Column:
    if cwe is None:
        return F.lit(None).cast("string")
    return F.lit(f"{cwe}: {C.CWE_NAMES.get(cwe, '')}")


@per_session
def user_input() -> Column:
    def build(pats):
        if not pats:
            return F.lit(False)
        return TEXT().rlike("(?i)" + "|".join("(?:%s)" % p.replace("(?i)", "", 1) for p in pats))
    return by_language(C.USER_INPUT_SOURCES, build, F.lit(False))


def _described(rule_id: str, **values: Column) -> Column:
    """The rule's description with its {placeholders} filled from columns."""
    pieces = re.split(r"\{(\w+)\}", C.RULE_TEXT[rule_id][1])
    return F.concat(*[values[x] if k % 2 else F.lit(x) for k, x in enumerate(pieces)])


def _finding(rule_id, severity: Column | str, fix: Column | str, description: Column | None = None,
             confidence: float = 0.8, match_ord: Column | int = 0) -> Column:
    name, desc, cwe, owasp = C.RULE_TEXT[rule_id]
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(name).alias("name"),
        (description if description is not None else F.lit(desc)).alias("description"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        cwe_label(cwe).alias("cwe"),
        F.lit(owasp).cast("string").alias("owasp"),
        (F.lit(fix) if isinstance(fix, str) else fix).alias("fix_suggestion"),
        F.lit(confidence).alias("confidence"),
        F.lit(C.DETECTOR_ORDER[rule_id]).alias("detector_ord"),
        (F.lit(match_ord) if isinstance(match_ord, int) else match_ord).cast("int").alias("match_ord"),
    )


def _opt(cond: Column, finding: Column) -> Column:
    return F.when(cond, F.array(finding))


def _first_call(needles: list) -> Column:
    """First call struct on the line whose name contains a needle, or null."""
    found = F.get(F.filter(F.col("calls"), lambda c: any_contains(c["name"], needles)), 0)
    return F.when(any_name_contains(needles), found) if needles else F.lit(None)


def _first_lower_call(needles: list) -> Column:
    """First call struct on the line whose lower-cased name contains a needle, or null."""
    found = F.get(F.filter(F.col("calls"), lambda c: any_contains(F.lower(c["name"]), needles)), 0)
    return F.when(F.lower("_names").rlike("|".join(re.escape(n) for n in needles)), found)


def _fix_sql() -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in C.FIX_SQL.items() for x in kv]), LANG()),
                      F.lit(C.FIX_SQL_DEFAULT))


def _fix_deser() -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in C.FIX_DESER.items() for x in kv]), LANG()),
                      F.lit(C.FIX_DESER_DEFAULT))


def line_findings(rules: set[str] | None = None) -> Column:
    """array<finding struct> of a line of a parsed language (built-in detectors D1-D15)."""
    return _line_findings(None if rules is None else frozenset(rules))


@per_session
def _line_findings(rules) -> Column:
    want = (lambda r: True) if rules is None else (lambda r: r in rules)
    ui = F.col("_user_input")
    parts = []
    sql_line = F.col("_hit") & any_rlike(TEXT(), C.SQL_INJECTION_PATTERNS)
    if want("SQL_INJECTION"):
        parts.append(_opt(sql_line, _finding("SQL_INJECTION", "high", _fix_sql())))
    if want("SQL_INJECTION_RISK"):
        c = _first_lower_call(C.SQL_CALL_NAMES)
        cond = ~sql_line & any_contains(TEXT(), C.SQL_RISK_LINE_MARKERS) & c.isNotNull()
        parts.append(_opt(cond, _finding("SQL_INJECTION_RISK", "medium", _fix_sql(), match_ord=c["ord"])))
    if want("COMMAND_INJECTION"):
        c = by_language(C.DANGEROUS_FUNCTIONS, _first_call)
        desc = _described("COMMAND_INJECTION", name=c["name"],
                          input=F.when(ui, C.COMMAND_INPUT_TEXT[0]).otherwise(C.COMMAND_INPUT_TEXT[1]))
        parts.append(_opt(c.isNotNull(), _finding("COMMAND_INJECTION", F.when(ui, "critical").otherwise("high"),
                                                   C.FIX_COMMAND, desc, match_ord=c["ord"])))
    if want("XSS"):
        parts.append(_opt(F.col("_hit") & any_rlike(TEXT(), C.XSS_PATTERNS), _finding("XSS", "high", C.FIX_XSS)))
    if want("SSRF"):
        parts.append(_opt(F.col("_hit") & any_rlike(TEXT(), C.SSRF_PATTERNS), _finding("SSRF", "high", C.FIX_SSRF)))
    if want("SSRF_RISK"):
        c = _first_call(C.URL_CALL_NAMES)
        parts.append(_opt(c.isNotNull() & ui, _finding("SSRF_RISK", "medium", C.FIX_SSRF, match_ord=c["ord"])))
    if want("PATH_TRAVERSAL"):
        parts.append(_opt(F.col("_hit") & any_rlike(TEXT(), C.PATH_TRAVERSAL_PATTERNS), _finding("PATH_TRAVERSAL", "high", C.FIX_PATH)))
    if want("PATH_TRAVERSAL_RISK"):
        c = _first_lower_call(C.FILE_CALL_NAMES)
        parts.append(_opt(c.isNotNull() & ui, _finding("PATH_TRAVERSAL_RISK", "medium", C.FIX_PATH,
                                                       match_ord=c["ord"])))
    if want("HARDCODED_SECRET"):
        parts.append(_opt(F.col("_hit") & any_rlike(TEXT(), C.SENSITIVE_DATA_PATTERNS),
                          _finding("HARDCODED_SECRET", "medium", C.FIX_SECRET)))
    if want("WEAK_CRYPTO"):
        parts.append(_opt(F.col("_hit") & any_rlike(TEXT(), C.WEAK_CRYPTO_PATTERNS), _finding("WEAK_CRYPTO", "medium", C.FIX_CRYPTO)))
    if want("DESERIALIZATION"):
        c = by_language(C.DESERIALIZATION_FUNCTIONS, _first_call)
        desc = _described("DESERIALIZATION", name=c["name"])
        parts.append(_opt(c.isNotNull(), _finding("DESERIALIZATION", "critical", _fix_deser(), desc,
                                                  match_ord=c["ord"])))
    if want("DANGEROUS_FUNCTION"):
        def first_pair(vals):
            if not vals:
                return F.lit(None)
            lst = F.array(*[F.lit(v) for v in vals])
            with_entry = F.transform(F.col("calls"), lambda c: F.struct(
                c["name"].alias("name"), c["ord"].alias("ord"),
                F.get(F.filter(lst, lambda d: c["name"].contains(d)), 0).alias("entry")))
            return F.when(any_name_contains(vals), F.get(F.filter(with_entry, lambda p: p["entry"].isNotNull()), 0))
        p = by_language(C.DANGEROUS_FUNCTIONS, first_pair)
        desc = _described("DANGEROUS_FUNCTION", name=p["name"])
        parts.append(_opt(p.isNotNull(), _finding("DANGEROUS_FUNCTION", danger_level(p["entry"]),
                                                  C.FIX_DANGEROUS, desc, match_ord=p["ord"])))
    if want("INSECURE_DEPENDENCY"):
        def first_imp(vals):
            if not vals:
                return F.lit(None)
            return F.get(F.filter(F.col("imports"), lambda i: _or(i["from"].contains(v) | (i["name"] == v)
                                                                  for v in vals)), 0)
        i = by_language(C.INSECURE_PACKAGES, first_imp)
        desc = _described("INSECURE_DEPENDENCY", **{"from": i["from"]})
        f = _finding("INSECURE_DEPENDENCY", "low", C.FIX_DEPENDENCY, desc, confidence=0.6)
        parts.append(_opt(i.isNotNull(), f))
    if want("XXE"):
        parts.append(_opt(F.col("_hit") & any_rlike(TEXT(), C.XXE_PATTERNS), _finding("XXE", "high", C.FIX_XXE)))
    if want("OPEN_REDIRECT"):
        parts.append(_opt(F.col("_hit") & any_rlike(TEXT(), C.OPEN_REDIRECT_PATTERNS),
                          _finding("OPEN_REDIRECT", "medium", C.FIX_REDIRECT)))
    empty = F.array().cast(_FINDINGS_T)
    return F.flatten(F.array(*[F.coalesce(p, empty) for p in parts])) if parts else empty


_FINDINGS_T = ("array<struct<rule_id:string,name:string,description:string,severity:string,cwe:string,"
               "owasp:string,fix_suggestion:string,confidence:double,detector_ord:int,match_ord:int>>")


@per_session
def fallback_findings() -> Column:
    """array<finding struct> of the fallback detector: every matching pattern of the line."""
    out = []
    for k, (pat, name, sev, desc) in enumerate(C.FALLBACK_PATTERNS):
        f = F.struct(F.lit("PATTERN_MATCH").alias("rule_id"), F.lit(name).alias("name"),
                     F.lit(desc).alias("description"), F.lit(sev).alias("severity"),
                     F.lit(None).cast("string").alias("cwe"), F.lit(None).cast("string").alias("owasp"),
                     F.lit(None).cast("string").alias("fix_suggestion"), F.lit(0.7).alias("confidence"),
                     F.lit(C.DETECTOR_ORDER["PATTERN_MATCH"]).alias("detector_ord"), F.lit(k).alias("match_ord"))
        out.append(F.when(TEXT().rlike(pat), F.array(f)).otherwise(F.array().cast(_FINDINGS_T)))
    return F.flatten(F.array(*out))


#: Rules that a line's text decides, with their patterns.
RULE_PATTERNS = {"SQL_INJECTION": C.SQL_INJECTION_PATTERNS, "SQL_INJECTION_RISK": C.SQL_INJECTION_PATTERNS, "XSS": C.XSS_PATTERNS,
                 "SSRF": C.SSRF_PATTERNS, "PATH_TRAVERSAL": C.PATH_TRAVERSAL_PATTERNS, "HARDCODED_SECRET": C.SENSITIVE_DATA_PATTERNS,
                 "WEAK_CRYPTO": C.WEAK_CRYPTO_PATTERNS, "XXE": C.XXE_PATTERNS, "OPEN_REDIRECT": C.OPEN_REDIRECT_PATTERNS}
#: Rules that names of calls decide, with these names in any language, and whether upper and lower case count as equal.
RULE_NAMES = {"SQL_INJECTION_RISK": (C.SQL_CALL_NAMES, True), "COMMAND_INJECTION": (C.DANGEROUS_FUNCTIONS, False),
              "SSRF_RISK": (C.URL_CALL_NAMES, False), "PATH_TRAVERSAL_RISK": (C.FILE_CALL_NAMES, True),
              "DESERIALIZATION": (C.DESERIALIZATION_FUNCTIONS, False), "DANGEROUS_FUNCTION": (C.DANGEROUS_FUNCTIONS, False)}


def _wanted(table: dict, rules) -> list:
    return [v for k, v in table.items() if rules is None or k in rules]


def line_patterns(rules: set[str] | None = None) -> list[str]:
    return list(dict.fromkeys(p for ps in _wanted(RULE_PATTERNS, rules) for p in ps))


def _values(names) -> list[str]:
    return [n for ns in names.values() for n in ns] if isinstance(names, dict) else list(names)


def may_match(text: Column, language: Column, rules: set[str] | None = None, fallback: str = "auto") -> Column:
    """False for lines that can have no finding, told from the raw text alone: most lines need no further reading.

    A finding needs a match of a line pattern, a call whose name holds a listed
    one, or an import of a listed package; names and packages are parts of the
    text.
    """
    parsed = any_rlike(text, line_patterns(rules))
    for lower in (False, True):
        names = list(dict.fromkeys(re.escape(n) for ns, low in _wanted(RULE_NAMES, rules) if low == lower for n in _values(ns)))
        if names:
            parsed = parsed | (text.contains("(") & text.rlike(("(?iu)" if lower else "") + "|".join(names)))
    if rules is None or "INSECURE_DEPENDENCY" in rules:
        parsed = parsed | text.rlike("|".join(re.escape(n) for n in dict.fromkeys(_values(C.INSECURE_PACKAGES))))
    other = any_rlike(text, [p[0] for p in C.FALLBACK_PATTERNS])
    if fallback == "only":
        return other
    return F.when(language.isin(*C.PARSED_LANGUAGES), parsed).otherwise(other if fallback == "auto" else F.lit(False))


def prepared(annotated: DataFrame, rules: set[str] | None = None) -> DataFrame:
    """What several detectors ask of a line, asked once: user input, any wanted line pattern at all, names of its calls."""
    return annotated.withColumns({"_user_input": user_input(), "_hit": any_rlike(TEXT(), line_patterns(rules)),
                                  "_names": F.array_join(F.col("calls")["name"], "\n")})


def findings_array(rules: set[str] | None = None, fallback: str = "auto") -> Column:
    """array<finding struct> of a prepared line under the given fallback mode."""
    none = F.array().cast(_FINDINGS_T)
    if fallback == "only":
        return fallback_findings()
    return F.when(LANG().isin(*C.PARSED_LANGUAGES), line_findings(rules)).otherwise(
        fallback_findings() if fallback == "auto" else none)


def detect(annotated: DataFrame, rules: set[str] | None = None, fallback: str = "auto",
           keep: tuple = ()) -> DataFrame:
    """annotated lines -> findings (one row per finding, duplicates already removed).

    fallback='auto': fallback detector on languages without fact rules only;
    'only': fallback detector on every line; 'off': never.
    """
    x = prepared(annotated, rules).select("path", "language", "line", *keep, F.explode(findings_array(rules, fallback)).alias("f"))
    return finalize_columns(x.select("path", "language", "line", *keep,
                                     *[F.col("f." + c).alias(c) for c in FINDING_FIELDS]))


def finalize_columns(f: DataFrame) -> DataFrame:
    """Add id and severity_rank to raw findings."""
    fid = F.when(F.col("rule_id") == "PATTERN_MATCH", fallback_id(F.col("name"), F.col("path"), F.col("line"))) \
        .otherwise(finding_id(F.col("rule_id"), F.col("path"), F.col("line")))
    return f.withColumn("id", fid).withColumn("severity_rank", severity_rank(F.col("severity")))


def scan_lines(code_lines: DataFrame, rules: set[str] | None = None, fallback: str = "auto") -> DataFrame:
    from vigil.operators.lines import annotate
    return detect(annotate(code_lines), rules, fallback)
