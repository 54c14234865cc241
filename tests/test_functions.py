"""Scalar goldens (FIXTURES §4) and helper functions."""
from pyspark.sql import functions as F

from vigil.functions.ids import finding_id, sarif_fingerprint
from vigil.functions.paths import detect_language, glob_to_regex
from vigil.functions.text import js_trim


def test_finding_id_golden(spark):
    r = spark.range(1).select(finding_id(F.lit("SQL_INJECTION"), F.lit("app.py"), F.lit(14)).alias("x")).first()
    assert r.x == "c285d3c4a87a"


def test_sarif_fingerprint_goldens(spark):
    df = spark.createDataFrame([("app.py", 14, "SQL_INJECTION"), ("src/app.js", 24, "DANGEROUS_FUNCTION")],
                               "p string, l int, r string")
    got = [r.h for r in df.select(sarif_fingerprint(F.col("p"), F.col("l"), F.col("r")).alias("h")).collect()]
    assert got == ["2e1d1453", "5c5ffd74"]


def test_line_split_keeps_trailing_pieces(lines_of):
    rows = lines_of({"a.py": "a\nb\n\n"}).orderBy("line").collect()
    assert [r.text for r in rows] == ["a", "b", "", ""]
    assert [r.line for r in rows] == [1, 2, 3, 4]


def test_utf8_repair(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "b binary")
    assert df.select(F.make_valid_utf8(F.col("b").cast("string")).alias("s")).first().s == "a�b"


def test_trim_all_whitespace(spark):
    df = spark.createDataFrame([("\t  x y\r　",)], "s string")
    assert df.select(js_trim(F.col("s")).alias("t")).first().t == "x y"


def test_language_detection(spark):
    df = spark.createDataFrame([("a/B.PY",), ("x.tsx",), ("q.rs",), ("noext",), ("m.php5",)], "p string")
    got = [r.l for r in df.select(detect_language(F.col("p")).alias("l")).collect()]
    assert got == ["python", "typescript", "rust", "python", "php"]


def test_glob_translation_is_anchored():
    import re
    rx = re.compile(glob_to_regex("**/test/**"))
    assert rx.match("src/test/a.js") and rx.match("test/a.js") and not rx.match("src/tests/a.js")


def expand(glob):
    """All globs without braces that a glob stands for."""
    for i, c in enumerate(glob):
        if c == "{":
            depth, parts, start = 0, [], i + 1
            for j in range(i, len(glob)):
                depth += (glob[j] == "{") - (glob[j] == "}")
                if glob[j] == "," and depth == 1:
                    parts.append(glob[start:j])
                    start = j + 1
                if depth == 0:
                    parts.append(glob[start:j])
                    return [x for p in parts for x in expand(glob[:i] + p + glob[j + 1:])]
    return [glob]


def segment(g, s):
    """Does one name match one segment of a glob?  Letter by letter."""
    if not g:
        return not s
    if g[0] == "*":
        return segment(g[1:], s) or (s != "" and segment(g, s[1:]))
    if not s:
        return False
    if g[0] == "[":
        end = g.index("]", 3 if g[1] in "!^" else 2)
        body = g[2 if g[1] in "!^" else 1:end]
        inside = any(s[0] == c for c in body.replace("a-c", "abc"))
        return inside != (g[1] in "!^") and segment(g[end + 1:], s[1:])
    return g[0] in ("?", s[0]) and segment(g[1:], s[1:])


def matches(glob, names):
    if not glob:
        return not names
    if glob[0] == "**":
        return (len(glob) == 1 and len(names) > 0) or matches(glob[1:], names) and len(glob) > 1 or (names != [] and matches(glob, names[1:]))
    return names != [] and segment(glob[0], names[0]) and matches(glob[1:], names[1:])


def test_globs_against_a_matcher():
    import itertools
    import random
    import re
    rng = random.Random(4)
    pieces = ["a", "b", "*", "?", "[a-c]", "[!ab]", "[^c]", "{a,b}", "{a,b*}c", "**", "x.", "{a/b,c}", "{,a}b", "[]a]"]
    globs = ["/".join("".join(rng.choice(pieces) for _ in range(rng.choice([1, 1, 2]))) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    globs += ["**", "**/a", "a/**", "**/a/**", "a/**/b", "{a,b}/**", "**/{a,b}", "*.x", "{**/a,b/**}"]
    paths = ["/".join(p) for n in (1, 2, 3) for p in itertools.product(["a", "b", "ab", "c", "x.a", "bc", ".h"], repeat=n)]
    for g in globs:
        rx = re.compile(glob_to_regex(g))
        plain = [x.replace("***", "**") for x in expand(g)]
        for p in rng.sample(paths, 60):
            want = any(matches([s if s == "**" else s for s in x.split("/")], p.split("/")) for x in plain)
            assert bool(rx.match(p)) == want, (g, p, want)


def test_globs_of_other_kinds(spark):
    import re
    from pyspark.sql import functions as F

    from vigil.functions.paths import excluded
    ok = lambda g, p: bool(re.match(glob_to_regex(g), p))
    assert ok("v{1..12}.py", "v12.py") and not ok("v{1..12}.py", "v13.py") and ok("{a}", "{a}") and ok("a{b", "a{b") and ok("[a", "[a")
    assert ok(r"\*.py", "*.py") and not ok(r"\*.py", "a.py") and ok("*.@(js|ts)?(x)", "a.tsx") and not ok("*.@(js|ts)?(x)", "a.py")
    assert ok("+([0-9]).c", "123.c") and not ok("+([0-9]).c", "a.c") and ok("[[:digit:]_]*", "_x") and not ok("[+-9]", "/") and ok("[+-9]", "5")
    assert ok("a**b", "axxb") and not ok("a**b", "ax/xb")
    df = spark.createDataFrame([("src/a.min.js",), ("src/keep.min.js",), ("lib/x/y.py",), ("lib/z.py",)], "p string")
    got = {r.p: r.e for r in df.select("p", excluded(F.col("p"), ["**/*.min.js", "!**/keep.*", "lib/{x,q}/**"]).alias("e")).collect()}
    assert got == {"src/a.min.js": True, "src/keep.min.js": False, "lib/x/y.py": True, "lib/z.py": False}


def test_rollups_add_up(spark, lines_of):
    from vigil import api
    from vigil.operators.summary import rollups
    f = api.scan(lines_of({"a.py": "eval(input())\npassword = 'abcdef'\n", "b.js": "el.innerHTML = q;\neval(q)\n", "c.rs": "system(x)\n"}))
    rows, n = rollups(f).collect(), f.count()
    assert [r.n_findings for r in rows if r.gid == 15] == [n]
    for gid in (6, 7, 10, 11, 12, 13, 14):
        assert sum(r.n_findings for r in rows if r.gid == gid) == n
    assert {r.language for r in rows if r.gid == 13} == {"python", "javascript", "rust"}
