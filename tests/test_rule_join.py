"""Rules DataFrames that are joined, not sent: the rows of the bounded way and of a literal scan."""
import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.operators import rulejoin, rulematch
from vigil.operators.rulejoin import EDGE, edged_sets, file_pairs, file_pieces, keyed_words, literal_filter, rules_table
from vigil.operators.rulematch import plain, rule_match, rule_rows

RULES = ("load_ord int, rule_id string, name string, description string, category string, severity string, languages array<string>, "
         "cwe string, owasp string, tags array<string>, patterns array<string>, fix_suggestion string")
FILES = "path string, language string, content string"


def rows(df):
    return sorted(repr(r) for r in df.collect())


def rule(k, rule_id, patterns, languages=("*",), load_ord=0, severity="HIGH", cwe="CWE-1", tags=("t",)):
    langs, tags = None if languages is None else list(languages), None if tags is None else list(tags)
    return load_ord, rule_id, f"name {k}", None, "c", severity, langs, cwe, None if k % 2 else "A1", tags, patterns, None if k % 3 else "fix"


def both(spark, files, rules):
    """Rows of the joined way, which are those of the other one."""
    files, rules = spark.createDataFrame(files, FILES), spark.createDataFrame(rules, RULES)
    joined, sent = rule_match(files, rules, 10), rule_match(files, rules)
    assert joined.dtypes == sent.dtypes
    got = rows(joined)
    assert got == rows(sent)
    return got


def test_more_rules_than_the_bound(spark):
    rng = random.Random(7)
    rules = [rule(i, f"R{i}", [rf"(?i)passw[o0]rd\s*=\s*.[a-z]{i}\b", rf"(?:cb|func f){i}\b"], rng.choice([("*",), None, ("go", "php")])) for i in range(700)]
    files = [(f"f{k}.go", rng.choice(["go", "php", "java"]), "\n".join(
        rng.choice([f"PASSWORD = 'a{rng.randrange(900)}'", f"func f{rng.randrange(900)}(x)", f"cb{rng.randrange(900)}_", "é𝒳 text 12 = 3", ""]) for _ in range(30)))
        for k in range(60)]
    got = both(spark, files, rules)
    want = sum(any(re.search(p, text) for p in r[10]) for _, lang, text in files for r in rules if r[6] in (None, ["*"]) or lang in r[6])
    assert len(got) == want > 400


def test_odd_rules_and_files(spark):
    rules = [rule(0, "TWICE", ["first"], load_ord=3), rule(1, "TWICE", ["second"], load_ord=5), rule(2, "TWICE", ["third"], load_ord=None),
             rule(3, None, ["first"]), rule(4, "NONE", None), rule(5, "EMPTY", []), rule(6, "BAD", ["[", None, "second", "(?<x"], severity="odd", cwe=None, tags=None),
             rule(7, "ANY", [r"never", r"\d", r"^\}$"], severity=None), rule(8, "BLANK", [""], ("go",)), rule(9, "NOWHERE", ["second"], ()),
             rule(10, "NULL_LANGUAGE", ["second"], (None, "php")), rule(11, "LONG", ["x" * 100 + "y?"]), rule(12, "ORDER", ["zzz", "third", "second"]),
             rule(13, "CWE", ["second"], cwe="XCWE-2CWE-3\nCWE-4"), rule(14, "LINES", [r"second[^)]*third"]), rule(15, "CASE", [r"(?iu)straße", r"(?i)STRASSE"]),
             rule(16, "SIGN", [EDGE + "ab" + EDGE, r"\bab\b"]), rule(17, "", ["first"], severity="İnfo")]
    texts = [None, "", "first", "a second one\n7", "third\nsecond\nthird", "x" * 99, "x" * 300, "STRASSE Straße", f"{EDGE}ab{EDGE} cab abc", "}\n", "SECOND", "second second"]
    files = [(f"f{k}", lang, t) for k, t in enumerate(texts) for lang in ("go", "php", None)] + [(None, "go", "second 1"), (None, None, "second 1")]
    got = both(spark, files + files[3:9] * 2, rules)
    assert len(got) > 80 and any("path=None" in r for r in got)


def test_no_rules_and_no_files(spark):
    assert both(spark, [("f", "go", "text")], [rule(0, "R", ["absent"]), rule(1, "BAD", ["["])]) == []
    assert both(spark, [("f", "go", None)], [rule(0, "R", ["absent", r"\d"])]) == []
    none = spark.createDataFrame([], FILES)
    assert rule_match(none, spark.createDataFrame([rule(0, "R", ["absent"])], RULES), 10).count() == 0


def test_rules_stay_out_of_the_driver(spark, monkeypatch):
    monkeypatch.setattr(rulematch, "_pack", None)
    rules = spark.range(3000).select(F.concat(F.lit("R"), "id").alias("rule_id"), F.array(F.concat(F.lit("key"), "id", F.lit(r"\b"))).alias("patterns"))
    collected, collect = [], type(rules).collect
    monkeypatch.setattr(type(rules), "collect", lambda self: [collected.append(r) or r for r in collect(self)])
    files = spark.createDataFrame([("a", "go", "key7 key2999 key3000"), ("b", "go", "no")], FILES)
    found = rule_match(files, rules, 1000)
    assert len(collected) <= 2 * rulejoin.BUILDERS  # tables of fixed size, not rules
    assert {(r.path, r.rule_id) for r in found.collect()} == {("a", "R7"), ("a", "R2999")}


@pytest.mark.parametrize("pattern, sets", [
    (r"key12\b", [("1key12",)]), (r"key12\b\s", [("1key12",)]), (r"key\b12", [("0key12",)]), (r"key=\b", [("0key=",)]), (r"(?:abc\b|def)", [("0def", "1abc")]),
    (r"\bkey", [("0key",)]), (r"abc\B", [("0abc",)]), (r"\b\d+", []), (r"(?iu)key\b", []), ("k" * 70 + r"\b", [("0" + "k" * 64,)]),
])
def test_literals_with_their_ends(pattern, sets):
    assert edged_sets(pattern) == sets


def test_every_match_holds_a_literal_of_each_set():
    rng = random.Random(11)
    pieces = ["abc", "de", "x", r"\s*", "[xy]", "(ab|cd)", "(?:abc|de)?", "z+", ".", "(?:q|rst){1,2}", r"\b", r"\b", "(?=a)", "k{2}", "[^x]", "(abc)*", r"(?:ab\b|cd)"]
    texts = ["".join(rng.choice("abcdexyzqrstk ABCD-") for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    for _ in range(200):
        pattern = rng.choice(["", "(?i)"]) + "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
        sets = edged_sets(pattern)
        for t in texts:
            if sets and re.search(pattern, t):
                for c in sets:
                    assert any(re.search(re.escape(w[1:]) + (r"(?!\w)" if w[0] == "1" else ""), plain(t)) for w in c), (pattern, t, c)


def test_pieces_of_long_texts(spark, monkeypatch):
    """Literals of all lengths, at and across the borders of what is read at a time."""
    monkeypatch.setattr(rulejoin, "WINDOW", 50)
    rng = random.Random(13)
    words = ["".join(rng.choice("abAB_é𝒳 ") for _ in range(n)) for n in (3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 63, 64, 65, 90) for _ in range(6)]
    table = spark.createDataFrame([rule(k, f"R{k}", [re.escape(w) + (r"\b" if k % 2 and w[-1] in "abAB_" else "")]) for k, w in enumerate(words)], RULES)
    texts = ["".join(rng.choice(words + ["-", "\n", "a"]) for _ in range(rng.randrange(1, 12))) for _ in range(80)] + ["", "a"] * 30
    files = spark.createDataFrame([(f"f{k}", "go", t) for k, t in enumerate(texts)], FILES)
    got = {(r.path, r.rule_id) for r in rule_match(files, table, 10).collect()}
    assert got == {(r.path, r.rule_id) for r in rule_match(files, table).collect()} and len(got) > 300


def test_few_pieces_pass_and_hot_ones_come_together(spark):
    rules = spark.createDataFrame([rule(i, f"R{i}", [rf"(?i)passw[o0]rd\s*=\s*.[a-z]{i}\b"]) for i in range(2000)], RULES)
    files = spark.createDataFrame([(f"f{k}", "go", f"Password = 'a{k}'\n" + "filler " * 50) for k in range(300)]
                                  + [(f"n{k}", "go", f"passport = 'a{k}'") for k in range(300)], FILES)
    files = files.withColumn("file", F.xxhash64("path", "language", "content")).coalesce(1)
    picked = rules_table(rule_rows(rules))
    shared = rulejoin._Shared(picked)
    pieces = file_pieces(files, literal_filter(keyed_words(picked, shared).select("piece"), shared))
    assert pieces.groupBy("piece").count().filter("count > 1").count() == 0  # a row for all files of a batch
    pairs = file_pairs(files, picked)
    assert pairs.count() <= 3 * 300  # the ends of a number, in files with the word that all rules need
