"""Rules given as a DataFrame (D17, J5 for packs of any size): literals pick candidates, regexes run on candidates only.

1. Every pattern is reduced to literals of which any match must hold at least
   one (``required_literals``).  A pattern without such literals, or one that
   Python cannot read, is a candidate everywhere.
   Further literals that any match must hold as well are kept beside them.
2. All literals make one Aho-Corasick automaton; a file's content is read once
   and yields the rules of its language that can match at all.  A pattern is
   looked up by the literals that the fewest patterns share, and counts only if
   its other ones are in the content, too: a word that is common to thousands of
   rules picks none of them by itself.  Upper and lower case A-Z count as equal
   here, so patterns with (?i) need nothing special.
3. The rules' own patterns are searched by Spark's regex functions on the
   candidate (file, rule) pairs: the first pattern in list order that matches
   decides, as in rule_scan, whose rows these are.

A file never meets a rule that its content cannot match.  The rules (at most
MAX_LIST_BYTES of text) are the broadcast side of the one join; a DataFrame of
more goes through ``rulejoin``, where they stay on the executors.
"""
from __future__ import annotations

import re
import sys
import uuid
from collections import Counter

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import catalog as C
from vigil.functions.paths import excluded
from vigil.operators.rulescan import finding_rows, rule_values, searched
from vigil.operators.wordlists import MAX_LIST_BYTES, automaton
from vigil.sources.rulepack import RulePack, rule_patterns, validate_patterns

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Shorter literals pick too little; more texts than this are no longer told one by one.
SHORTEST, MOST_TEXTS = 3, 32
RULE = ("rule_no int, languages array<string>, tries array<struct<pattern_no:int,pattern:string>>, rule_id string, name string, description string, severity string, "
        "cwe string, owasp string, fix_suggestion string, tags array<string>, references array<string>")


def plain(text: str) -> str:
    """A-Z in lower case, nothing else changed."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _parsed(pattern: str):
    """Python's reading of the pattern, or None."""
    if re.search(r"\(\?[a-z]*[uU]", pattern):  # case by Unicode's rules
        return None
    try:
        return re._parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None


def required_literals(pattern: str) -> list[str] | None:
    """Literals (A-Z lowered) of which every match of the pattern holds at least one; None where there are none to name."""
    tree = _parsed(pattern)
    best = _required(tree) if tree else None
    return sorted(set(best)) if best else None


def required_sets(pattern: str) -> list[tuple[str, ...]]:
    """All sets of literals (A-Z lowered) of which every match holds at least one each; empty where there are none to name."""
    tree = _parsed(pattern)
    return sorted({tuple(sorted(set(c))) for c in _choices(tree)}) if tree and _required(tree) else []


def _exact(items, edge: str = "") -> set[str] | None:
    """All texts that the items match (A-Z lowered), or None if they are not a few fixed ones; anchors take no character.

    ``edge``, where given, stands for a word boundary in the texts.
    """
    out = {""}
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            more = {plain(chr(arg))}
        elif op == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            more = {plain(chr(v)) for _, v in arg}
        elif op == "SUBPATTERN":
            more = _exact(arg[-1], edge)
        elif op == "ATOMIC_GROUP":
            more = _exact(arg, edge)
        elif op == "BRANCH":
            parts = [_exact(branch, edge) for branch in arg[1]]
            more = set().union(*parts) if all(p is not None for p in parts) else None
        elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] in (0, 1) and arg[1] == 1:
            inner = _exact(arg[2], edge)
            more = inner if inner is None or arg[0] else inner | {""}
        elif edge and op == "AT" and str(arg) == "AT_BOUNDARY":
            more = {edge}
        elif op in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        else:
            more = None
        if edge and op in ("LITERAL", "IN") and more and edge in more:
            more = None  # the sign itself
        if more is None or len(out) * len(more) > MOST_TEXTS:
            return None
        out = {x + y for x in out for y in more}
    return out


def _required(tree, edge: str = "") -> list[str] | None:
    """The choice whose shortest literal is longest (then the smaller one)."""
    choices = [c for c in _choices(tree, edge) if min(len(w.replace(edge, "")) for w in c) >= SHORTEST]
    return max(choices, key=lambda c: (min(map(len, c)), -len(c)), default=None)


def _choices(tree, edge: str = "") -> list[list[str]]:
    """Literals of one character at least, of each list of which a match holds one."""
    choices, run = [], [""]  # run: what the fixed items since the last cut match

    def cut():
        if run != [""]:
            choices.append(sorted(run))
        run[:] = [""]

    def walk(items):
        for item in items:
            op, arg = str(item[0]), item[1]
            if op == "LITERAL" and chr(arg) != edge:
                c = plain(chr(arg))
                run[:] = [x + c for x in run]
                continue
            own = _exact([item], edge)
            if own is not None and len(run) * len(own) <= MOST_TEXTS:
                run[:] = {x + y for x in run for y in own}
                continue
            if op == "SUBPATTERN":
                walk(arg[-1])
                continue
            if op == "ATOMIC_GROUP":
                walk(arg)
                continue
            cut()
            if own is not None:
                run[:] = own
            elif op == "BRANCH":
                parts = [_required(branch, edge) for branch in arg[1]]
                if all(parts):
                    choices.append([w for p in parts for w in p])
            elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                if inner := _required(arg[2], edge):
                    choices.append(inner)

    walk(tree)
    cut()
    return [c for c in choices if min(map(len, c))]


#: Columns of a rules DataFrame that are read, and what those that are not there are.
FIELDS = {"load_ord": "long", "rule_id": "string", "name": "string", "description": "string", "category": "string", "severity": "string",
          "languages": "array<string>", "cwe": "string", "owasp": "string", "tags": "array<string>", "patterns": "array<string>", "fix_suggestion": "string"}


def rule_rows(rules: DataFrame) -> DataFrame:
    """The columns of a rules DataFrame that are read, of rules with an id."""
    have = set(rules.columns)
    return rules.select(*[F.col(f) if f in have else F.lit(None).cast(t).alias(f) for f, t in FIELDS.items()]).filter("rule_id IS NOT NULL")


def _size(rows: DataFrame) -> int:
    """Bytes of the rules' text."""
    return rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*FIELDS))).cast("long"))).first()[0] or 0


def pack_of(rules: DataFrame, max_bytes: int = MAX_LIST_BYTES) -> RulePack:
    """A rules DataFrame as a validated pack, in load_ord order.

    Needs rule_id and patterns; load_ord, name, description, category, severity,
    languages (none: all), cwe, owasp, tags and fix_suggestion where they are
    there.  Rules with a null id and a repeated id's earlier rules go, as in a
    rule file; patterns that Java cannot compile are listed in ``errors``.
    """
    rows = rule_rows(rules)
    size = _size(rows)
    if size > max_bytes:
        raise ValueError(f"the rules have {size} bytes, more than {max_bytes}")
    return _pack(rows)


def _pack(rows: DataFrame) -> RulePack:
    by_id = {}
    for r in sorted(rows.collect(), key=lambda r: (r.load_ord is not None, r.load_ord or 0, r.rule_id)):
        by_id[r.rule_id] = {"id": r.rule_id, "name": r.name, "description": r.description, "category": r.category, "severity": r.severity,
                            "languages": list(r.languages) if r.languages is not None else ["*"], "cwe": r.cwe, "owasp": r.owasp,
                            "tags": list(r.tags or []), "patterns": [p for p in r.patterns or [] if p is not None],
                            "fixSuggestion": r.fix_suggestion}
    return validate_patterns(rows.sparkSession, RulePack(rules=list(by_id.values())))


class Index:
    """Rules (number, languages, required sets of each pattern) by the literals of their patterns."""

    def __init__(self, pack: list[tuple]):
        import ahocorasick
        self.always: list[int] = []  # rules that no literal picks
        self.languages = []
        patterns, shared = [], Counter()
        for number, langs, sets in pack:
            self.languages.append(None if "*" in langs else frozenset(langs))
            if not all(sets):
                self.always.append(number)
                continue
            patterns += [(number, s) for s in sets]
            shared.update({w for s in sets for c in s for w in c})
        self.by_word: dict[str, list] = {}  # literal -> (rule, the other literals that it needs)
        words = set()
        for number, sets in patterns:
            key = min(sets, key=lambda c: (max(shared[w] for w in c), -min(map(len, c)), len(c)))
            others = tuple(c for c in sets if c != key and min(map(len, c)) >= SHORTEST)
            for w in key:
                self.by_word.setdefault(w, []).append((number, others))
            words.update(key, *others)
        self.automaton = ahocorasick.Automaton()
        for w in words:
            self.automaton.add_word(w, w)
        if words:
            self.automaton.make_automaton()

    def rules(self, content: str, language: str | None) -> list[int]:
        """Rules of the language that can match in the content."""
        picked = set(self.always)
        found = {w for _, w in self.automaton.iter(plain(content))} if len(self.automaton) else set()
        for w in found & self.by_word.keys():
            for number, others in self.by_word[w]:
                if number not in picked and all(not found.isdisjoint(c) for c in others):
                    picked.add(number)
        return sorted(k for k in picked if self.languages[k] is None or language in self.languages[k])


def candidates(files: DataFrame, rules: list[dict]) -> DataFrame:
    """(path, language, content, rules): files that some rule can match, with the numbers of those rules."""
    sc = files.sparkSession.sparkContext
    read = sc.parallelize([(k, list(r.get("languages") or []), rule_patterns(r)) for k, r in enumerate(rules)])
    # patterns are read once, by the cluster, not by every worker; what they need is no longer than they are, times MOST_TEXTS at worst
    shipped = sc.broadcast(read.map(lambda r: (r[0], r[1], [required_sets(p) for p in r[2]])).collect())
    key = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa
        index = automaton(key, lambda: Index(shipped.value))
        for batch in batches:
            picked = [[] if content is None else index.rules(content, language)
                      for language, content in zip(batch.column("language").to_pylist(), batch.column("content").to_pylist())]
            keep = pa.array([bool(p) for p in picked])
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(picked, pa.list_(pa.int32()))], ["path", "language", "content", "rules"])
            yield out.filter(keep)

    return files.select("path", "language", "content").mapInArrow(run, "path string, language string, content string, rules array<int>")


def rule_match(files: DataFrame, rules: DataFrame | RulePack, max_bytes: int = MAX_LIST_BYTES) -> DataFrame:
    """rule_scan's rows for a pack of any size: source_files(path, language, content) against a rules DataFrame (or a pack).

    A DataFrame of more than ``max_bytes`` is joined (``rulejoin``), not sent.
    """
    spark = files.sparkSession
    if isinstance(rules, RulePack):
        pack = rules
    else:
        rows = rule_rows(rules)
        if _size(rows) > max_bytes:
            from vigil.operators.rulejoin import joined_rule_match
            return joined_rule_match(files, rows, max_bytes)
        pack = _pack(rows)
    least = C.SEVERITY_RANK.get(str(pack.config.get("minSeverity") or "").lower(), 0)
    values = [rule_values(r) for r in pack.rules]
    chosen = [(r, v) for r, v in zip(pack.rules, values) if C.SEVERITY_RANK[v["severity"]] >= least and rule_patterns(r)]
    if pack.config.get("exclude"):
        files = files.filter(~excluded(F.col("path"), list(pack.config["exclude"])))
    rows = [(k, list(r.get("languages") or []), list(enumerate(rule_patterns(r))), *(v[f] for f in (
        "rule_id", "name", "description", "severity", "cwe", "owasp", "fix_suggestion", "tags", "references"))) for k, (r, v) in enumerate(chosen)]
    table = spark.createDataFrame(rows, RULE).drop("languages")
    x = candidates(files, [r for r, _ in chosen]).select("path", "language", "content", F.explode("rules").alias("rule_no"))
    x = x.join(F.broadcast(table), "rule_no")  # its size was checked, or it came from the driver's own files
    return finding_rows(searched(x))
