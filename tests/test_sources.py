"""File discovery, per-file errors, manifests, rule packs and the streaming scan."""
import os
import time

import pytest
from pyspark.sql import functions as F

from vigil import api
from vigil.sources.files import dependency_manifests, file_errors, read_source_files
from vigil.sources.rulepack import load_rule_pack
from vigil.streaming.scan import start_scan

CODE = "import pickle\npassword = 'hunter22'\nos.system(request.args.get('c'))\n"


def put(root, files: dict):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


FILES = {"a.py": CODE, "pkg/b.js": "eval(x)\n", "pkg/C.PY": "x = 1\n", "node_modules/m/i.js": "eval(y)\n", "dist/o.js": "z",
         "pkg/notes.txt": "no", "sp ace/d+%é.py": "y = 2\n", "bad.py": b"s = '\xff'\n"}
WANT = {"a.py", "pkg/b.js", "pkg/C.PY", "sp ace/d+%é.py", "bad.py"}


@pytest.mark.parametrize("place", ["plain", "build/p", "c++", "vendor/x y/dist"])
@pytest.mark.parametrize("spelling", ["absolute", "relative", "uri", "slash"])
def test_every_spelling_of_a_root(spark, tmp_path, place, spelling):
    root = str(tmp_path / place)
    put(root, FILES)
    given = {"absolute": root, "relative": os.path.relpath(root), "uri": "file://" + root, "slash": root + "/"}[spelling]
    got = read_source_files(spark, given)
    assert {r.path for r in got.collect()} == WANT
    assert {r.path for r in read_source_files(spark, given, language="javascript").collect()} == {"pkg/b.js"}


def test_contents_are_repaired_and_detected(spark, tmp_path):
    put(str(tmp_path), FILES)
    rows = {r.path: r for r in read_source_files(spark, str(tmp_path)).collect()}
    assert rows["bad.py"].content == "s = '�'\n" and rows["pkg/C.PY"].language == "python"
    assert rows["a.py"].size == len(CODE) and rows["pkg/b.js"].language == "javascript"


def test_excluded_and_large_files_are_not_opened(spark, tmp_path):
    put(str(tmp_path), {"ok.py": "x\n", "node_modules/big.py": "y" * 5000, "big.py": "z" * 5000})
    got = read_source_files(spark, str(tmp_path), max_bytes=1000)
    assert [r.path for r in got.collect()] == ["ok.py"]
    errors = file_errors(spark, str(tmp_path), max_bytes=1000).collect()
    assert [(r.path, "5000 bytes" in r.error) for r in errors] == [("big.py", True)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_file_cap_reads_in_extension_order(spark, tmp_path):
    put(str(tmp_path), {"b.js": "1", "a.js": "1", "z.py": "1", "y.py": "1"})
    all_ = [r.path for r in read_source_files(spark, str(tmp_path)).collect()]
    assert len(all_) == 4
    assert {r.path for r in read_source_files(spark, str(tmp_path), max_files=3).collect()} == {"y.py", "z.py", "a.js"}


def test_manifests_of_roots_with_and_without(spark):
    listing = spark.createDataFrame([("p/package.json",), ("p/src/a.js",), ("q/go.mod",)], "path string")
    roots = spark.createDataFrame([("p",), ("empty",)], "root string")
    rows = dependency_manifests(listing, roots=roots).collect()
    by = {}
    for r in rows:
        by.setdefault(r.root, []).append(r)
    assert {k: sum(r.present for r in v) for k, v in by.items()} == {"p": 1, "q": 1, "empty": 0}
    assert all(len(v) == 8 for v in by.values())


def test_stream_loses_no_file_and_equals_batch(spark, tmp_path):
    root, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    put(root, {"new.py": CODE, "node_modules/skip.py": CODE})
    start_scan(spark, root, out, ckpt).awaitTermination()
    put(root, {"sub/old.py": CODE})
    long_ago = time.time() - 7200
    os.utime(os.path.join(root, "sub/old.py"), (long_ago, long_ago))
    start_scan(spark, root, out, ckpt).awaitTermination()
    streamed = sorted(r.id for r in spark.read.parquet(out).collect())
    batch = sorted(r.id for r in api.scan(read_source_files(spark, root)).collect())
    assert streamed == batch and len({r.path for r in spark.read.parquet(out).collect()}) == 2


@pytest.mark.parametrize("root", ["", "../up", "a\0b"])
def test_outside_roots_can_be_validated(spark, root):
    with pytest.raises(ValueError):
        read_source_files(spark, root, validate=True)


# ------------------------------------------------------------- rule packs
def rule(id_, pattern, **more):
    return {"id": id_, "name": id_, "languages": ["*"], "severity": "high", "patterns": [pattern], **more}


def test_rule_lines_of_anchored_patterns(spark):
    pack = api.load_rules(extra_rules=[rule("ANCHORED", r"^b\b"), rule("WIDE", r"zz$"), rule("OFF", "a", enabled=False)], spark=spark)
    files = spark.createDataFrame([("f.txt", "text", "ab\n𝒳𝒳zz\nb\n")], "path string, language string, content string")
    rows = {r.rule_id: r.line for r in api.rule_scan(files, pack).collect()}
    assert rows == {"ANCHORED": 3, "WIDE": 2}


def test_pack_config_is_honoured(spark):
    files = spark.createDataFrame([("src/a.py", "python", "exec(x)"), ("src/test/a.py", "python", "exec(x)"),
                                   ("x.spec.py", "python", "exec(x)")], "path string, language string, content string")
    pack = api.load_rules(spark=spark)
    assert {r.path for r in api.rule_scan(files, pack).collect()} == {"src/a.py"}
    pack.config = {"minSeverity": "critical", "exclude": []}
    found = api.rule_scan(files.withColumn("content", F.lit("exec(x)\npassword = 'abc'")), pack).collect()
    assert {r.rule_id for r in found} == {"COMMAND_INJECTION_EXEC"} and len(found) == 3


def test_empty_pack_keeps_the_schema(spark):
    from vigil.sources.rulepack import RulePack
    files = spark.createDataFrame([("a.py", "python", "exec(x)")], "path string, language string, content string")
    full = api.rule_scan(files, api.load_rules(spark=spark))
    assert api.rule_scan(files, RulePack()).dtypes == full.dtypes
    assert api.rule_scan(files, RulePack()).count() == 0


def test_bad_rules_are_skipped_and_reported(tmp_path):
    (tmp_path / "a.yaml").write_text("rules:\n  - {name: no id, enabled: true}\n  - {id: GOOD, enabled: true, patterns: ['x']}\n  -\n")
    (tmp_path / "b.yaml").write_text("rules: [\n")
    (tmp_path / "c.yml").write_text("- just a list\n")
    pack = load_rule_pack(str(tmp_path))
    assert [r["id"] for r in pack.rules] == ["GOOD"] and len(pack.errors) == 4


def spoil(path):
    """A checksum that the file does not have: Hadoop's local file system refuses to read it."""
    folder, name = os.path.split(path)
    with open(os.path.join(folder, f".{name}.crc"), "wb") as f:
        f.write(b"crc\x00" + (512).to_bytes(4, "big") + b"\x01\x02\x03\x04")


def test_one_pass_over_a_tree_gives_findings_errors_and_counts(spark, tmp_path):
    from vigil.operators.results import scan_tree
    from vigil.streaming.scan import start_tree_scan
    root = str(tmp_path / "t")
    put(root, {**FILES, "line.py": "\n", "empty.py": "", "big.py": "z" * 5000, "torn.py": CODE, "sub/x.js": "eval(req.body)\n" * 3, "o[d]{d}*.py": "y"})
    spoil(os.path.join(root, "torn.py"))
    scan = scan_tree(spark, root, str(tmp_path / "batch"), max_bytes=1000)
    want = api.scan(read_source_files(spark, root, max_bytes=1000)).collect()
    assert sorted(r.id for r in scan.findings.collect()) == sorted(r.id for r in want)
    files = {r.path for r in scan.files.collect()}
    assert files == WANT | {"line.py", "sub/x.js", "o[d]{d}*.py"}  # Spark lists no empty files
    errors = {tuple(r) for r in scan.errors.collect()}
    assert errors == {("big.py", "Failed to analyze big.py: 5000 bytes, more than 1000"), ("torn.py", "Failed to analyze torn.py: cannot be read")}
    assert errors == {tuple(r) for r in file_errors(spark, root, max_bytes=1000).collect()}
    counts = scan.counts
    assert (counts["total_files"], counts["total_issues"], counts["errors"]) == (len(files), len(want), 2)
    assert all(counts[s] == sum(r.severity == s for r in want) for s in ("critical", "high", "medium", "low", "info"))
    summary = spark.read.json(str(tmp_path / "batch/summary")).first()
    assert summary.errorCount == 2 and summary.summary.totalIssues == len(want)
    # a stream, two files at a time: the same rows, and the oversized file does not stop it
    q = start_tree_scan(spark, root, str(tmp_path / "stream"), str(tmp_path / "ckpt"), max_files_per_trigger=4, max_bytes=1000)
    assert q.awaitTermination(240) and q.exception() is None
    out = str(tmp_path / "stream")
    assert {tuple(r) for r in spark.read.parquet(f"{out}/errors").select("path", "error").collect()} == errors
    rows = spark.read.parquet(f"{out}/rows")
    assert rows.select("batch").distinct().count() > 1
    assert sorted(r.id for r in rows.filter("kind = 'findings'").collect()) == sorted(r.id for r in want)
    assert {r.path for r in rows.filter("kind = 'files'").collect()} == files


def test_an_empty_tree(spark, tmp_path):
    from vigil.operators.results import scan_tree
    (tmp_path / "t").mkdir()
    scan = scan_tree(spark, str(tmp_path / "t"), str(tmp_path / "o"))
    assert scan.findings.count() == scan.files.count() == scan.errors.count() == 0 and scan.counts["total_files"] == 0


def test_a_result_is_written_from_one_evaluation(spark, tmp_path, lines_of):
    lines = lines_of({"a.py": CODE, "b.js": "eval(x)\n"})
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return x
    findings = api.scan(lines).withColumn("description", counted(F.col("description")))
    n = api.scan(lines).count()
    api.write_result(findings, str(tmp_path / "r"), lines, target="t")
    assert calls.value == n
    head = spark.read.json(str(tmp_path / "r/summary")).first()
    assert (head.summary.totalIssues, head.summary.totalFiles, head.errorCount, head.targetPath) == (n, 2, 0, "t")
    assert spark.read.json(str(tmp_path / "r/findings")).count() == n
