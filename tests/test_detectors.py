"""Detector semantics on small inline files (own samples, goldens derived by reading the rules)."""
from vigil import api

PY = """import os
import pickle
def handler(req):
    q = request.args.get('id')
    os.system(q)
    return eval(q)
password = "hunter22"
cur.execute("SELECT * FROM t WHERE a=" + q)
cur.execute(f"SELECT * FROM t WHERE a={q}")
"""

JS = """const a = require('child_process');
function run(req) {
  exec(req.query.cmd);
  el.innerHTML = req.body.x;
}
"""


def found(df):
    return {(r.rule_id, r.line, r.severity) for r in df.collect()}


def test_python_sample(lines_of):
    got = found(api.scan(lines_of({"s/app.py": PY})))
    assert ("INSECURE_DEPENDENCY", 2, "low") in got
    assert ("SSRF_RISK", 4, "medium") in got
    assert ("COMMAND_INJECTION", 5, "high") in got
    assert ("DANGEROUS_FUNCTION", 5, "critical") in got
    assert ("COMMAND_INJECTION", 6, "high") in got
    assert ("HARDCODED_SECRET", 7, "medium") in got
    # concatenation after the literal: no line pattern, but the call-based risk rule fires;
    # 'cur.execute' also contains the dangerous name 'exec' (substring test)
    assert ("SQL_INJECTION_RISK", 8, "medium") in got
    assert ("COMMAND_INJECTION", 8, "high") in got
    assert ("SQL_INJECTION", 9, "high") in got
    # SQL_INJECTION_RISK is suppressed on a line that already has SQL_INJECTION
    assert not any(r == "SQL_INJECTION_RISK" and ln == 9 for r, ln, _ in got)
    # 'import os' is not an insecure package
    assert not any(r == "INSECURE_DEPENDENCY" and ln == 1 for r, ln, _ in got)


def test_js_sample_and_dedup(lines_of):
    f = api.scan(lines_of({"s/app.js": JS}))
    got = found(f)
    assert ("INSECURE_DEPENDENCY", 1, "low") in got
    assert ("COMMAND_INJECTION", 3, "critical") in got   # user input on the line
    assert ("DANGEROUS_FUNCTION", 3, "critical") in got
    assert ("XSS", 4, "high") in got
    # one finding per (rule, path, line)
    keys = [(r.rule_id, r.path, r.line) for r in f.collect()]
    assert len(keys) == len(set(keys))
    # the function header line has no calls, so no call-based finding there
    assert not any(ln == 2 for _, ln, _ in got)


def test_fallback_for_languages_without_fact_rules(lines_of):
    rows = api.scan(lines_of({"x.rs": 'let password = "abc";\nsystem(x); exec(y)\n'})).collect()
    assert {(r.rule_id, r.line, r.name) for r in rows} == {
        ("PATTERN_MATCH", 1, "硬编码密码"), ("PATTERN_MATCH", 2, "命令注入风险")}
    assert sum(1 for r in rows if r.line == 2) == 2   # no dedup in the fallback detector
    assert all(r.confidence == 0.7 for r in rows)


def test_quick_is_subset_and_summary_sums(lines_of):
    lines = lines_of({"s/app.py": PY, "s/app.js": JS})
    std = api.scan(lines)
    quick = api.scan(lines, mode="quick")
    assert {r.id for r in quick.collect()} <= {r.id for r in std.collect()}
    s = api.severity_summary(std, lines).first()
    assert s.total_issues == s.critical + s.high + s.medium + s.low + s.info == std.count()
    assert s.total_files == 2


def test_scan_independent_of_partitioning(lines_of):
    lines = lines_of({"s/app.py": PY, "s/app.js": JS})
    a = sorted(r.id for r in api.scan(lines.repartition(1)).collect())
    b = sorted(r.id for r in api.scan(lines.repartition(7)).collect())
    assert a == b


def test_dedup_window_is_idempotent(lines_of):
    from vigil.operators.finalize import dedup_findings
    f = api.scan(lines_of({"s/app.py": PY}))
    once = dedup_findings(f.unionByName(f))
    assert sorted(r.id for r in once.collect()) == sorted(r.id for r in f.collect())


def test_lines_that_are_passed_over_have_no_finding(spark, lines_of):
    """scan() with its test of the raw text against the detectors on every line."""
    import random

    from vigil.operators.detect import detect
    from vigil.operators.lines import annotate
    from vigil.sources.corpus import FILE_TEMPLATES, TEMPLATES
    rng = random.Random(8)
    base = [t[4] for t in TEMPLATES] + [x for t in FILE_TEMPLATES for x in t[3]] + [
        "OPEN(request.args)", "File_Get_Contents($_GET['x'])", "x.EXECUTE (f\"a\")", "import pickle", "from yaml import load as l", "pickle",
        "const { a } = require('vm2')", "do_eval()", "eval (x)", "Popen[(1)]", "# exec(x)", "password='longenough1'", "-----BEGIN", "", "é eval(x)"]
    files = {}
    for ext in ("py", "js", "ts", "go", "java", "php", "rs", "rb"):
        lines = []
        for _ in range(150):
            a, b = rng.choice(base), rng.choice(base)
            cut = rng.randrange(len(a) + 1)
            lines.append(rng.choice([a, a[:cut] + b, a.upper(), a[cut:], a + " " + b]))
        files[f"m.{ext}"] = "\n".join(lines)
    lines = lines_of(files)
    for mode, rules, fallback in (("standard", None, "auto"), ("quick", None, "auto"), ("standard", {"XSS", "SSRF_RISK"}, "off"), ("standard", None, "only")):
        want = detect(annotate(lines), rules, fallback)
        if mode == "quick":
            want = want.filter("severity IN ('critical', 'high')")
        got = api.scan(lines, mode=mode, rules=rules, fallback=fallback)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    src = spark.createDataFrame([(p, "python", t) for p, t in files.items()], "path string, language string, content string")
    with_context = {(r.path, r.line, r.rule_id, r.match_ord): r.snippet for r in api.scan(src, context=2).collect()}
    for (path, line, _, _), s in with_context.items():
        pieces = files[path].split("\n")
        assert s.code == "\n".join(pieces[max(line - 3, 0):line + 2]) and s.start_line == max(line - 2, 1)
