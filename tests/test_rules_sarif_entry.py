"""Rule packs, SARIF rows, taint points and the driver contract."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from vigil import api
from vigil.sources.rulepack import load_rule_pack, validate_patterns


def test_default_pack_loads():
    p = load_rule_pack()
    assert len(p.rules) == 22 and sum(len(r["patterns"]) for r in p.rules) == 30


def test_pack_merge_disabled_duplicate_and_bad_regex(spark):
    d = tempfile.mkdtemp(prefix="vigil-rules-", dir="/tmp")
    open(os.path.join(d, "a.yaml"), "w").write(
        "rules:\n  - {id: R1, severity: low, languages: ['*'], enabled: true, patterns: ['foo']}\n"
        "  - {id: R2, severity: low, languages: ['*'], enabled: false, patterns: ['bar']}\n")
    open(os.path.join(d, "b.yml"), "w").write(
        "rules:\n  - {id: R1, severity: HIGH, languages: ['*'], enabled: true, patterns: ['(unclosed', 'fo+\\s*\\(']}\n")
    open(os.path.join(d, "c.yaml"), "w").write("rules: [ {broken\n")
    p = validate_patterns(spark, load_rule_pack(d))
    assert [r["id"] for r in p.rules] == ["R1"]
    assert p.rules[0]["_patterns"] == ["fo+\\s*\\("]
    assert any("c.yaml" in str(e[1]) for e in p.errors) and any(e[0] == "R1" for e in p.errors)
    files = spark.createDataFrame([("x/a.txt", "text", "line one\nfoo\n   (call)\n")], "path string, language string, content string")
    f = api.rule_scan(files, p).collect()
    assert [(r.rule_id, r.line, r.severity) for r in f] == [("R1", 2, "high")]   # match spans lines


def test_sarif_rows_match_findings(lines_of):
    lines = lines_of({"a.py": "eval(x)\npassword = 'zz'\n"})
    f = api.scan(lines, context=3)
    rules, res = api.sarif(f)
    assert res.count() == f.count()
    idx = sorted(r.rule_index for r in rules.collect())
    assert idx == list(range(len(idx)))
    from vigil.operators.sarif import sarif_log
    import json
    doc = json.loads(sarif_log(f).first().sarif)
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == f.count()
    region = doc["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]
    assert region["snippet"]["text"] == "eval(x)\npassword = 'zz'\n"


def test_equal_fallback_ids_stay_apart(lines_of):
    """Two calls on one line share name, path and line, hence the id."""
    from vigil.operators.sarif import sarif_log, sarif_results
    import json
    lines = lines_of({"app.rs": "a\na\nsystem(x); exec(y)\nb\n"})
    f = api.scan(lines, fallback="only", context=3)
    rows = f.collect()
    assert len(rows) == 2 and len({r.id for r in rows}) == 1
    assert {r.snippet.code for r in rows} == {"a\na\nsystem(x); exec(y)\nb\n"} and rows[0].snippet.start_line == 1
    joined = api.snippets(f, lines).collect()
    assert len(joined) == 2 and {r.snippet.code for r in joined} == {rows[0].snippet.code}
    assert sarif_results(f).count() == 2
    assert len(json.loads(sarif_log(f).first().sarif)["runs"][0]["results"]) == 2


def test_snippets_of_files_and_of_lines_agree(spark, lines_of, monkeypatch):
    from vigil.operators import finalize
    monkeypatch.setattr(finalize, "CONTEXT_BLOCK", 8)
    text = "".join(f"eval(x{i})\n" if i % 3 == 0 else f"l{i}\n" for i in range(60))
    files = spark.createDataFrame([("a.py", "python", text), ("b.py", "python", "exec(z)")], "path string, language string, content string")
    by_file = {(r.path, r.line, r.rule_id): r.snippet for r in api.scan(files, context=3).collect()}
    by_line = {(r.path, r.line, r.rule_id): r.snippet for r in api.scan(lines_of({"a.py": text, "b.py": "exec(z)"}), context=3).collect()}
    assert by_file == by_line and len(by_file) > 40


def test_sarif_logs_per_project(lines_of):
    from vigil.operators.sarif import sarif_log
    f = api.scan(lines_of({"p/a.py": "eval(x)\n", "q/b.py": "password = 'zz'\n", "q/c.py": "exec(x)\n"}))
    logs = {r.project: r.sarif for r in sarif_log(f, F.element_at(F.split("path", "/"), 1)).collect()}
    assert set(logs) == {"p", "q"} and "b.py" in logs["q"] and "b.py" not in logs["p"]


def test_json_result(spark, lines_of, tmp_path):
    import json
    lines = lines_of({"a.py": "eval(x)\npassword = 'zz'\n"})
    f = api.scan(lines)
    errors = spark.createDataFrame([("z.py", "Failed to analyze z.py")], "path string, error string")
    api.write_result(f, str(tmp_path / "out"), lines, errors, "a")
    assert spark.read.json(str(tmp_path / "out/findings")).count() == f.count()
    head = spark.read.json(str(tmp_path / "out/summary")).first()
    assert head.summary.totalIssues == f.count() and head.summary.totalFiles == 1 and head.errorCount == 1
    doc = json.loads(api.result_document(f, lines, errors, "a").first().json)
    assert len(doc["vulnerabilities"]) == f.count() and doc["errors"] == ["Failed to analyze z.py"]
    assert doc["vulnerabilities"][0]["severity"] == "critical"


def test_remediation_texts(spark, lines_of):
    f = api.with_remediation(api.scan(lines_of({"a.py": "cur.execute(q + x)\neval(request.args.get('c'))\n"})))
    rows = {r.rule_id: r for r in f.collect()}
    assert rows["SQL_INJECTION_RISK"].remediation_references[-1].endswith("89.html")
    plain = rows["DANGEROUS_FUNCTION"]
    assert plain.remediation_summary == plain.description and plain.remediation_mitigation == plain.fix_suggestion
    assert plain.remediation_references == ["https://owasp.org/www-community/vulnerabilities/", "https://cwe.mitre.org/"]


def test_grouping_sorting_and_levels(lines_of):
    from vigil.operators.finalize import chunked, line_content
    lines = lines_of({"a.py": "eval(x)\n" * 30 + "password = 'zz'\n", "b.py": "md5(x)\nimport pickle\n"})
    f = api.scan(lines)
    groups = {r.path: r for r in api.findings_by_file(f).collect()}
    assert groups["a.py"].n_findings == f.filter("path = 'a.py'").count() and groups["a.py"].max_severity_rank == 5
    assert {r.path: r["count"] for r in api.top_findings_by_file(f, 7).groupBy("path").count().collect()}["a.py"] == 7
    ranks = [r.severity_rank for r in api.sort_findings(f).collect()]
    assert ranks == sorted(ranks, reverse=True)
    assert api.scan(lines, min_severity="high").filter("severity_rank < 4").count() == 0
    quick, full = api.scan(lines, mode="quick"), f.filter("severity IN ('critical', 'high')")
    assert {(r.id, r.severity) for r in quick.collect()} == {(r.id, r.severity) for r in full.collect()}
    sizes = chunked(f, 4).groupBy("path", "chunk").count().collect()
    assert max(r["count"] for r in sizes) == 4
    got = line_content(lines, lines.sparkSession.createDataFrame([("a.py", 31), ("a.py", 99)], "path string, line int")).collect()
    assert {r.line: r.text for r in got} == {31: "password = 'zz'", 99: ""}


def test_every_default_rule_hits_the_file_corpus(spark):
    docs = spark.range(14).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    pack = api.load_rules(spark=spark)
    hit = {r.rule_id for r in api.rule_scan(api.corpus_files(docs), pack).select("rule_id").distinct().collect()}
    assert hit == {r["id"] for r in pack.rules}


def test_taint_points(lines_of):
    rows = api.taint_points(lines_of({"a.py": "x = input('q')\neval(x)\n"})).collect()
    assert {(r.line, r.kind, r.label) for r in rows} == {(1, "source", "用户输入函数"), (2, "sink", "eval()")}


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "rule_id" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def joined(folder):
    """The files of a document one after another, in name order."""
    out = []
    for section in sorted(os.listdir(folder)):
        for name in sorted(os.listdir(os.path.join(folder, section))):
            if name.startswith("part-"):
                with open(os.path.join(folder, section, name), encoding="utf-8") as f:
                    out.append(f.read())
    return "".join(out)


def test_documents_in_parts_are_the_one_row_documents(spark, lines_of, tmp_path):
    from vigil.operators.sarif import sarif_log
    lines = lines_of({f"d{i}/a.py": "eval(input())\n\npassword = 'ab\"cé'\n" * 40 for i in range(8)} | {"b.js": "el.innerHTML = q;\n"})
    f = api.scan(lines, context=2).repartition(7)
    f = f.unionByName(f.limit(3))  # equal rows, as in a union with other findings
    f = spark.createDataFrame(f.collect(), f.schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a small table keeps its tasks
    try:
        api.write_sarif(f, str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got, want = json.loads(joined(tmp_path / "s")), json.loads(sarif_log(f).first().sarif)
    assert got["runs"][0]["tool"] == want["runs"][0]["tool"]
    order = [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in got["runs"][0]["results"]]
    assert order == [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in want["runs"][0]["results"]]
    assert sorted(map(json.dumps, got["runs"][0]["results"])) == sorted(map(json.dumps, want["runs"][0]["results"]))
    assert len([n for n in os.listdir(tmp_path / "s" / "03") if n.startswith("part-")]) > 2  # several tasks wrote the results
    errors = spark.createDataFrame([('x "q" \\ \n',), ("a",)], "error string")
    api.write_result_document(f, str(tmp_path / "r"), 9, errors, "t")
    got, want = json.loads(joined(tmp_path / "r")), json.loads(api.result_document(f, lines, errors, "t").first().json)
    assert {k: got[k] for k in got if k != "vulnerabilities"} == {k: want[k] for k in want if k != "vulnerabilities"}
    assert [v["location"]["file"] for v in got["vulnerabilities"]] == [v["location"]["file"] for v in want["vulnerabilities"]]
    assert sorted(map(json.dumps, got["vulnerabilities"])) == sorted(map(json.dumps, want["vulnerabilities"]))
    api.write_sarif(f.limit(0), str(tmp_path / "e"))
    assert json.loads(joined(tmp_path / "e"))["runs"][0]["results"] == []
    api.write_result_document(f.limit(0), str(tmp_path / "er"))
    assert json.loads(joined(tmp_path / "er"))["vulnerabilities"] == []
