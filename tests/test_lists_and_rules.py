"""User lists of any length, and rules given as a DataFrame, against literal contains and a literal scan."""
import random
import re

import pytest
from pyspark.sql import functions as F

from vigil import api
from vigil.operators import wordlists
from vigil.operators.rulematch import candidates, pack_of, plain, required_literals, rule_match
from vigil.operators.wordlists import first_listed
from vigil.sources.rulepack import load_rule_pack, rules_dataframe

ENTRIES = "entry string, ord long, language string"


def brute(name, language, entries):
    hits = [(o, e) for e, o, g in entries if e is not None and name is not None and e in name and g in (None, language)]
    return min(hits, default=None)


def check(spark, rows, entries, **kw):
    df = spark.createDataFrame(rows, "name string, language string, grp int")
    got = first_listed(df, "name", spark.createDataFrame(entries, ENTRIES), "hit", "language", **kw).collect()
    assert sorted(map(repr, ((r.name, r.language, tuple(r.hit) if r.hit else None) for r in got))) \
        == sorted(repr((n, g, brute(n, g, entries))) for n, g, _ in rows)


def test_first_hit_in_list_order(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé.𝒳") for _ in range(n))
    entries = [(word(rng.randrange(1, 4)), rng.randrange(10 ** 6), rng.choice([None, "go", "php"])) for _ in range(80)]
    rows = [(word(rng.randrange(0, 9)), rng.choice(["go", "php", "java", None]), 1) for _ in range(300)] + [(None, "go", 1), ("", None, 1)]
    check(spark, rows, entries)
    check(spark, rows, entries + [("", 500_000, "go"), (None, 1, None), ("a", None, None)][:2])
    check(spark, rows, [("zz", 3, None)])
    check(spark, rows, entries, max_bytes=400)  # in parts
    empty = first_listed(spark.createDataFrame(rows, "name string, language string, grp int"), "name", spark.createDataFrame([], ENTRIES))
    assert empty.filter("listed IS NOT NULL").count() == 0 and empty.count() == len(rows)


def test_a_long_list_stays_out_of_the_driver(spark, monkeypatch):
    monkeypatch.setattr(wordlists, "HOT_ROWS", 50)
    monkeypatch.setattr(wordlists, "PIECES", 3)
    rows = [("hot.call", "go", 1)] * 200 + [(f"h{i}_1x", "php" if i % 2 else None, i) for i in range(60)] + [(None, None, 0), ("", "go", 0), ("none", "go", 0)]
    entries = [(f"h{i}_1", 1000 - i, "php" if i % 3 else None) for i in range(60)] * 3 + [("call", 9, None), ("hot", 5, "go"), ("hot.call.long", 1, None)]
    check(spark, rows, entries, max_bytes=100)
    check(spark, rows, entries + [("", 2000, "go")], max_bytes=100)
    monkeypatch.setattr(wordlists, "_entries_automaton", None)  # no automaton of a list this long
    collected, collect = [], type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: [collected.append(r) or r for r in collect(self)])
    wordlists.first_listed(spark.createDataFrame(rows, "name string, language string, grp int"), "name",
                           spark.createDataFrame(entries, ENTRIES), "hit", "language", 100)
    assert len(collected) <= 10  # lengths, not entries


def test_a_hundred_thousand_names_without_a_nested_loop(spark, lines_of):
    lines = lines_of({"a.py": "".join(f"obj.name{i}x(a)\n" for i in range(0, 200_000, 500))})
    entries = spark.range(100_000).select(F.concat(F.lit("name"), (F.col("id") * 2).cast("string"), F.lit("x")).alias("entry"), F.col("id").alias("ord"))
    found = api.listed_calls(lines, entries)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
    assert {(r.name, r.entry) for r in found.collect()} == {(f"obj.name{i}x", f"name{i}x") for i in range(0, 200_000, 500)}


@pytest.mark.parametrize("pattern, literals", [
    (r"eval\s*\(", ["eval"]), (r"(?i)PassWord\s*=", ["password"]), (r"\.format\s*\([^)]*\).*SELECT", [".format"]), (r"a.b|c", None),
    (r"subprocess\.(call|run|Popen).*shell\s*=\s*True", ["subprocess.call", "subprocess.popen", "subprocess.run"]), (r"x*y?", None),
    (r"(?:cb|func f)12\b", ["cb12", "func f12"]), (r"api[_-]?key\s*=", ["api-key", "api_key", "apikey"]), (r"(abc){2,}", ["abc"]),
    (r"foo\bbar(?=baz)qux", ["foobarqux"]), (r"(?iu)straße", None), (r"\p{Alpha}+", None), (r"[^a]bc", None), (r"", None), (r"(?:ab|c[0-9])", None),
])
def test_required_literals(pattern, literals):
    assert required_literals(pattern) == literals


def test_every_match_holds_a_required_literal():
    rng = random.Random(3)
    pieces = ["abc", "de", "x", r"\s*", "[xy]", "(ab|cd)", "(?:abc|de)?", "z+", ".", "(?:q|rst){1,2}", r"\b", "(?=a)", "k{2}", "[^x]", "(abc)*"]
    texts = ["".join(rng.choice("abcdexyzqrstk ABCD") for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    for _ in range(150):
        pattern = rng.choice(["", "(?i)"]) + "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
        needed = required_literals(pattern)
        for t in texts:
            if needed and re.search(pattern, t):
                assert any(w in plain(t) for w in needed), (pattern, t, needed)


def test_a_word_that_all_rules_share_picks_none(spark):
    table = spark.createDataFrame([(f"R{i}", [rf"(?i)passw[o0]rd\s*=\s*.[a-z]{i}\b", rf"(?:cb|func f){i}\b"]) for i in range(400)],
                                  "rule_id string, patterns array<string>")
    files = spark.createDataFrame([(f"f{k}.py", "python", f"Password = 'a{k}'\n" + "func f7 x" * (k == 17) + "filler " * 20) for k in range(0, 400, 8)]
                                  + [("n.py", "python", "password and nothing else"), ("m.py", "python", "399 alone")],
                                  "path string, language string, content string")
    found = {(r.path, r.rule_id) for r in api.rule_match(files, table).collect()}
    assert found == {(f"f{k}.py", f"R{k}") for k in range(0, 400, 8)}
    pairs = candidates(files, pack_of(table).rules).select(F.sum(F.size("rules"))).first()[0]
    assert pairs <= 7 * 50  # a number's parts, not every rule of every file with a password


def scan_rows(df):
    return sorted(repr(r) for r in df.collect())


def test_default_pack_as_a_dataframe_gives_the_scans_rows(spark):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "eval (x) 𝒳\nSELECT a +\nb").alias("text"))
    files = api.corpus_files(docs)
    pack = load_rule_pack()
    pack.config = {}
    want = scan_rows(api.rule_scan(files, pack))
    assert len(want) > 50
    assert scan_rows(api.rule_match(files, rules_dataframe(spark, pack))) == want
    # a pack's own config holds as in the scan
    pack.config = {"minSeverity": "high", "exclude": ["**/*.py"]}
    assert scan_rows(rule_match(files, pack)) == scan_rows(api.rule_scan(files, pack))


def test_thousands_of_rules(spark):
    rng = random.Random(5)
    rules = [(f"R{i:04}", ["python"] if i % 2 else None, [rf"(?i)call{i}\s*\(", rf"^key{i}$"] + ([r"["] if i == 7 else [])) for i in range(5000)]
    table = spark.createDataFrame(rules + [(None, None, ["x"]), ("EMPTY", None, None), ("ANY", ["go"], [r"\w\d{4}\b"])],
                                  "rule_id string, languages array<string>, patterns array<string>")
    files = [(f"f{k}.{e}", lang, "\n".join(rng.choice([f"Call{rng.randrange(5200)} (x)", f"key{rng.randrange(5200)}", "key 1", ""]) for _ in range(20)))
             for k in range(12) for e, lang in (("py", "python"), ("go", "go"))] + [("n.py", "python", None), ("e.py", "python", "")]
    want = set()
    for path, lang, text in files:
        for rid, langs, pats in [*rules, ("ANY", ["go"], [r"\w\d{4}\b"])]:
            if text is None or (langs and lang not in langs):
                continue
            for k, p in enumerate(pats):
                m = re.search("(?m)" + p, text, re.M) if p != "[" and "(?i)" not in p else re.search(p, text) if p != "[" else None
                if m:
                    want.add((rid, path, text[:m.start()].count("\n") + 1, k))
                    break
    df = spark.createDataFrame(files, "path string, language string, content string")
    got = {(r.rule_id, r.path, r.line, r.match_ord) for r in api.rule_match(df, table).collect()}
    assert got == want and len(want) > 150
    pack = pack_of(table)
    assert [e[0] for e in pack.errors] == ["R0007"] and len(pack.rules) == 5002
    # few pairs reach a regex
    pairs = candidates(df, pack.rules).select(F.sum(F.size("rules"))).first()[0]
    assert pairs < 3 * len(want) + 2 * len(files)
    with pytest.raises(ValueError, match="more than"):
        pack_of(table, max_bytes=1000)
