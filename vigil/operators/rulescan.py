"""Rule-pack scan over whole file contents (D17, D19) and rule selection.

Per (file, rule): the first pattern in list order that matches anywhere in
the content ('m' semantics: '\\s' and '[^)]' may span lines) decides the
finding; its line is the line of the leftmost match.  At most one finding per
(file, rule).  Patterns are literals; every one is searched at most once per
file, and only where the content holds a literal that it needs; one number per
rule (pattern, offset) is kept until rows are made, so the scan is one narrow pass over the file rows with no join and no shuffle.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import catalog as C
from vigil.functions.ids import finding_id
from vigil.functions.paths import excluded
from vigil.functions.severity import severity_rank
from vigil.sources.rulepack import RulePack, rule_patterns

#: A hit is pattern number * HIT_SHIFT + offset of the match.
HIT_SHIFT = 1 << 32


def rules_for_language(pack: RulePack, language: str) -> list:
    """Rules whose languages list holds the language or '*'."""
    return [r for r in pack.rules if language in (r.get("languages") or []) or "*" in (r.get("languages") or [])]


def rules_by(pack: RulePack, category: str | None = None, severity: str | None = None, rule_id: str | None = None):
    """Equality filters over the rule list."""
    return [r for r in pack.rules if (category is None or r.get("category") == category)
            and (severity is None or r.get("severity") == severity) and (rule_id is None or r["id"] == rule_id)]


def _rule_hit(rule: dict) -> Column:
    """Number of the first matching pattern and the offset of its leftmost match, or null.

    A pattern is only searched in contents that hold one of its required literals.
    """
    from vigil.operators.rulematch import required_literals
    offsets = []
    for k, p in enumerate(rule_patterns(rule)):
        at = F.nullif(F.regexp_instr(F.col("content"), F.lit("(?m)" + p)), F.lit(0)).cast("long") + F.lit(k * HIT_SHIFT)
        literals = required_literals(p)
        if literals:
            at = F.when(reduce(lambda a, b: a | b, [F.col("_plain").contains(w) for w in literals]), at)
        offsets.append(at)
    hit = F.coalesce(*offsets) if offsets else F.lit(None).cast("long")
    langs = list(rule.get("languages") or [])
    return hit if "*" in langs else F.when(F.col("language").isin(*langs), hit) if langs else F.lit(None).cast("long")


def _texts(vals) -> Column:
    return F.array(*[F.lit(v) for v in vals]) if vals else F.array().cast("array<string>")


def _severity(rule: dict) -> str:
    level = (rule.get("severity") or "").lower()
    return level if level in C.SEVERITY_RANK else "medium"


def rule_values(rule: dict) -> dict:
    """What a rule adds to its findings."""
    cwe, owasp = rule.get("cwe") or "", rule.get("owasp") or ""
    return {"rule_id": rule["id"], "name": rule.get("name"), "description": rule.get("description"), "severity": _severity(rule),
            "cwe": rule.get("cwe"), "owasp": rule.get("owasp"), "fix_suggestion": rule.get("fixSuggestion") or "",
            "tags": list(rule.get("tags") or []),
            "references": [f"https://cwe.mitre.org/data/definitions/{cwe.replace('CWE-', '', 1)}.html", f"https://owasp.org/Top10/{owasp}/"]}


def _rule_struct(rule: dict) -> Column:
    return F.struct(*[(_texts(v) if isinstance(v, list) else F.lit(v).cast("string")).alias(k) for k, v in rule_values(rule).items()])


def line_of(content: Column, offset: Column) -> Column:
    """Line of a 1-based offset in UTF-16 units, as Java's matcher counts; only the text before it is read."""
    units = F.regexp_replace(F.substr(content, F.lit(1), offset - 1), r"[\x{10000}-\x{10FFFF}]", "xx")
    before = F.substr(units, F.lit(1), offset - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def rule_scan(files: DataFrame, pack: RulePack) -> DataFrame:
    """source_files(path, language, content) -> rule findings (one row per matched (file, rule)).

    The pack's config holds here: files that its ``exclude`` globs match are
    left out, and so are rules below ``minSeverity``.
    """
    least = C.SEVERITY_RANK.get(str(pack.config.get("minSeverity") or "").lower(), 0)
    rules = [r for r in pack.rules if C.SEVERITY_RANK[_severity(r)] >= least]
    globs = [g for g in pack.config.get("exclude") or []]
    if globs:
        files = files.filter(~excluded(F.col("path"), globs))
    hits = F.array(*[_rule_hit(r) for r in rules]) if rules else F.array().cast("array<bigint>")
    none = {"id": "", "languages": []}
    table = F.array(*[_rule_struct(r) for r in rules or [none]])
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    x = files.select("path", "language", "content", F.translate("content", letters, letters.lower()).alias("_plain"))
    x = x.select("path", "language", "content", F.posexplode(hits).alias("rule", "hit")).filter("hit IS NOT NULL")
    return finding_rows(x.select("path", "language", "content", "hit", F.get(table, F.col("rule")).alias("r")).select(
        "path", "language", "content", "hit", "r.*"))


def searched(x: DataFrame) -> DataFrame:
    """The rows of (content, tries) with a match, and its hit: that of the first of ``tries`` (pattern_no, pattern) that matches.

    Every pattern is searched once: the hit goes through a generator, so that no filter repeats it, and an array holds the offset.
    """

    def step(hit, t):
        offsets = F.filter(F.array(F.regexp_instr(F.col("content"), F.concat(F.lit("(?m)"), t["pattern"]))), lambda at: at > 0)
        return F.coalesce(hit, F.get(offsets, F.lit(0)).cast("long") + t["pattern_no"].cast("long") * F.lit(HIT_SHIFT))

    hit = F.aggregate("tries", F.lit(None).cast("long"), step)
    return x.select(*[c for c in x.columns if c != "tries"], F.explode_outer(F.array(hit)).alias("hit")).filter("hit IS NOT NULL")


def located(hits: DataFrame) -> DataFrame:
    """hits plus line and pattern_ord of (content, hit)."""
    return hits.withColumn("line", line_of(F.col("content"), F.col("hit") % HIT_SHIFT)) \
        .withColumn("pattern_ord", F.floor(F.col("hit") / HIT_SHIFT).cast("int"))


def finding_rows(hits: DataFrame) -> DataFrame:
    """Findings of (path, language, content, hit, values of the rule)."""
    return rows_of(located(hits))


def rows_of(x: DataFrame) -> DataFrame:
    """Findings of (path, language, line, pattern_ord, values of the rule)."""
    return x.select(finding_id(F.col("rule_id"), F.col("path"), F.col("line")).alias("id"),
                    "rule_id", "name", "description", "severity", severity_rank(F.col("severity")).alias("severity_rank"),
                    "path", "language", "line", "cwe", "owasp", "fix_suggestion", F.lit(0.8).alias("confidence"),
                    F.lit(C.DETECTOR_ORDER["RULE_PACK"]).alias("detector_ord"),
                    F.col("pattern_ord").alias("match_ord"), "tags", "references", F.lit(1).alias("column"))
