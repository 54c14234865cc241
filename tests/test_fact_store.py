"""The fact store after batches with changed and deleted files against one batch run."""
import os
import random

from vigil import api
from vigil.sources.files import read_source_files
from vigil.streaming.facts import FactStore, start_facts


def rows(df, drop=()):
    return sorted(repr(r) for r in df.select(*[c for c in sorted(df.columns) if c not in drop]).collect())


def same_as_batch(store, files):
    nodes, edges = api.call_graph(files, strict_order=False)
    assert rows(store.edges()) == rows(edges)
    assert rows(store.nodes()) == rows(nodes)
    assert rows(store.functions()) == rows(api.functions(files))
    assert rows(store.classes()) == rows(api.classes(files))


def content(rng, names):
    out = []
    for _ in range(rng.randrange(1, 4)):
        n = rng.choice(names)
        out += [f"class K{n}(B):", f"    def {n}(self, a, b=1):", f"        {rng.choice(names)}(a)", f"        x = {rng.choice(names)}(b, a)"]
    return "\n".join(out) + "\n"


def source(spark, files):
    return spark.createDataFrame([(p, "python" if p.endswith("py") else "go", t) for p, t in files.items()], "path string, language string, content string")


def test_batches_equal_one_run(spark, tmp_path):
    rng = random.Random(7)
    names = [f"n{i}" for i in range(9)]
    store, state = FactStore(spark, str(tmp_path / "store"), buckets=5), {}
    for batch in range(4):
        put = {f"d/f{rng.randrange(9)}.py": content(rng, names) for _ in range(4)}
        gone = rng.sample(sorted(set(state) - set(put)), min(2, len(set(state) - set(put)))) if batch else []
        if batch == 2:
            put["g.go"] = "func n1(a string) {\n  n2(a)\n}\nfunc n2(b string) {\n}\n"
            put[sorted(put)[0]] = ""  # a file that loses all it had
        deleted = spark.createDataFrame([(p,) for p in gone] + [("never/there.py",)], "path string")
        store.apply(batch, source(spark, put), deleted)
        state = {**{p: t for p, t in state.items() if p not in gone}, **put}
    same_as_batch(store, source(spark, state))
    before = rows(store.edges())
    store.apply(3, source(spark, put), deleted)  # a replay changes nothing
    assert rows(store.edges()) == before
    # all goes: nothing is left
    store.apply(4, source(spark, {"z.py": ""}), spark.createDataFrame([(p,) for p in state], "path string"))
    assert store.edges().count() == store.functions().count() == store.classes().count() == 0


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), buckets=64)
    store.apply(0, source(spark, {f"f{i}.py": f"def a{i}(x):\n    b{i}(x)\n" for i in range(40)}))
    first = store._manifest(None)
    store.apply(1, source(spark, {"g.py": "def b7(x):\n    pass\n"}))
    moved = {k for k, v in store._manifest(None).items() if v == 1}
    assert {t for t, _ in moved} == {"files", "functions", "owned", "defs", "calls"} and len(moved) <= 7
    assert all(store._manifest(None)[k] == v for k, v in first.items() if k not in moved)
    # the call of another file resolves to the new definition
    assert [(r.path, r.to_name) for r in store.edges().collect()] == [("f7.py", "b7")]


def test_stream_with_changed_and_deleted_files(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()

    def put(name, text, when):
        (tree / name).write_text(text)
        os.utime(tree / name, (when, when))

    def run():
        q = start_facts(spark, str(tree), store, str(tmp_path / "ckpt"), max_files_per_trigger=2)
        assert q.awaitTermination(240) and q.exception() is None
        same_as_batch(store, read_source_files(spark, str(tree)))

    store = FactStore(spark, str(tmp_path / "store"), buckets=4)
    put("a.py", "def f(x):\n    g(x)\n", 1_000_000)
    put("b.py", "def g(x):\n    h(x)\n", 1_000_100)
    put("c.js", "function h(a) {\n  h(a);\n}\n", 1_000_050)
    run()
    put("a.py", "def k(x):\n    g(x)\n    k(x)\n", 1_000_200)
    put("d.py", "def g(x):\n    k(x)\n", 900_000)
    os.remove(tree / "c.js")
    run()
    assert {r.path for r in store.table("files").collect()} == {"a.py", "b.py", "d.py"}
    os.remove(tree / "d.py")
    store.sync(100, str(tree))  # without a new file: by hand
    same_as_batch(store, read_source_files(spark, str(tree)))


def test_an_empty_store(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "none"))
    assert store.edges().count() == 0 and store.functions().count() == 0
