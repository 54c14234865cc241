"""Structural facts, end lines and call graph."""
from vigil import api

JS = """class A extends B {
function f(x, y = 2) {
  var s = "{ not a brace";
  g(x);
}
function g(z) { return 1; }
f(1);
"""

PY = """@export
def top(a, b: int = 3):
    return helper(a)
class K(Base, Mixin):
    def m(self):
        return top(1)
def helper(q):
    pass
"""


def test_brace_end_lines(lines_of):
    fns = {r.name: r for r in api.functions(lines_of({"a.js": JS})).collect()}
    # the string holds '{', so f's braces never return to depth 0 before the file end
    assert fns["f"].end_line == 8
    assert fns["g"].end_line == 6
    cls = api.classes(lines_of({"a.js": JS})).first()
    assert cls.end_line == 8        # unclosed class -> file end
    assert [p.name for p in fns["f"].parameters] == ["x", "y"]
    assert fns["f"].parameters[1].default_value == "2"


def test_python_facts(lines_of):
    fns = {r.name: r for r in api.functions(lines_of({"m.py": PY})).collect()}
    assert fns["top"].decorators == ["export"] and fns["top"].is_exported
    assert fns["top"].end_line == 3
    assert fns["m"].class_name == "K" and fns["m"].is_method
    assert fns["helper"].is_method          # a class header came earlier in the file
    assert fns["helper"].method_of_line is None   # but it is not indented
    assert fns["m"].end_line == 6
    assert [(p.name, p.type, p.default_value) for p in fns["top"].parameters] == [("a", None, None), ("b", "int", "3")]
    k = [r for r in api.classes(lines_of({"m.py": PY})).collect()][0]
    assert k.parent_class == "Base" and k.interfaces == ["Mixin"] and k.end_line == 6


def test_call_graph(lines_of):
    nodes, edges = api.call_graph(lines_of({"m.py": PY}))
    assert {(r.from_name, r.to_name) for r in edges.collect()} == {("top", "helper"), ("m", "top")}
    ids = {r.node_id for r in nodes.collect()}
    assert all(r.from_id in ids and r.to_id in ids for r in edges.collect())


def test_asof_name_resolution_uses_file_order(lines_of):
    files = {"a.py": "def f():\n    g()\n", "b.py": "def g():\n    pass\n", "c.py": "def h():\n    g()\n"}
    _, edges = api.call_graph(lines_of(files))
    # a.py is read before g is defined in b.py: no edge; c.py resolves to b.py's g
    assert {(r.path, r.to_name) for r in edges.collect()} == {("c.py", "g")}
    _, anywhere = api.call_graph(lines_of(files), strict_order=False)
    assert {(r.path, r.to_name) for r in anywhere.collect()} == {("a.py", "g"), ("c.py", "g")}


def test_many_unclosed_functions_in_one_file(lines_of):
    """Every function runs to the file's end; each call belongs to the first of them, at a cost linear in the lines."""
    n = 5000
    text = "".join(f"function f{i}() {{\n  f0(x);\n" for i in range(n))
    nodes, edges = api.call_graph(lines_of({"big.js": text}))
    assert nodes.count() == n
    rows = edges.groupBy("from_name", "to_name").count().collect()
    assert [(r.from_name, r.to_name, r["count"]) for r in rows] == [("f0", "f0", n)]


def test_python_end_lines_with_many_indents(lines_of):
    import random
    rng = random.Random(1)
    indents = [rng.choice([0, 1, 2, 3, 4, 7, 8, 12, 40, 3000]) for _ in range(120)]
    text = "".join(" " * k + f"def f{i}(a):\n" for i, k in enumerate(indents))
    got = {r.name: r.end_line for r in api.functions(lines_of({"x.py": text}), with_params=False).collect()}
    for i, k in enumerate(indents):
        nxt = next((j for j in range(i + 1, len(indents)) if indents[j] <= k), None)
        # the text ends in a line feed, so the file has one more, empty line
        assert got[f"f{i}"] == (nxt if nxt is not None else len(indents) + 1)


def test_typescript_parameters_split_outside_brackets(lines_of):
    src = ("function a(x: Map<string, Array<[number, string]>>, ...rest: string[], y?: string = 'q') {\n}\n"
           "function b(cb: (u) => void, z) {\n}\nfunction c() {\n}\n")
    fns = {r.name: r.parameters for r in api.functions(lines_of({"p.ts": src})).collect()}
    assert [(p.name, p.type, p.is_optional, p.is_variadic) for p in fns["a"]] == [
        ("x", "Map<string, Array<[number, string]>>", False, False), ("rest", "string[]", False, True), ("y", "string", True, False)]
    assert fns["c"] == []


def test_enums_and_first_functions(lines_of):
    from vigil.operators.profile import first_functions
    src = "export enum Color { R }\n" + "".join(f"function g{i}() {{}}\n" for i in range(30))
    assert [(r.name, r.line, r.is_exported) for r in api.variables(lines_of({"e.ts": src})).collect()] == [("Color", 1, True)]
    top = first_functions(api.functions(lines_of({"e.ts": src}), with_params=False), 20).collect()
    assert sorted(r.line for r in top) == list(range(2, 22))


def test_reachability_from_given_starts(spark):
    from vigil.operators.graph import counts, reachable
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "from_id string, to_id string")
    starts = spark.createDataFrame([("a",)], "src string")
    got = {(r.src, r.dst): r.depth for r in reachable(e, starts).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "a"): 3, ("a", "d"): 3}
    assert {r.dst for r in reachable(e, starts, max_depth=2).collect()} == {"b", "c"}
    assert {r.name: r.n for r in counts(edges=e, starts=starts).collect()} == {"edges": 5, "starts": 1}


def test_taint_candidates_stay_in_their_function(lines_of):
    src = "def f():\n    x = input('q')\n    y = 1\n    eval(x)\ndef g():\n    eval(y)\n"
    rows = api.taint_candidates(lines_of({"t.py": src})).collect()
    assert [(r.function, r.source_line, r.sink_line) for r in rows] == [("f", 2, 4)]


def test_python_end_lines_of_any_depth(lines_of):
    import random
    rng = random.Random(2)
    files = {"shallow.py": "  def a(x):\n    def b(x):\n", "deep.py": " " * 3000 + "def a(x):\n" + " " * 3100 + "def b(x):\n" + " " * 3000 + "def c(x):\n"}
    indents = [rng.choice([0, 1, 30, 2046, 2047, 2048, 4094, 4095, 4096, 5000, 9000, 20_000]) for _ in range(60)]
    files["many.py"] = "".join(" " * k + f"def f{i}(a):\n" for i, k in enumerate(indents))
    got = {(r.path, r.name): r.end_line for r in api.functions(lines_of(files), with_params=False).collect()}
    assert [got["deep.py", n] for n in "abc"] == [2, 2, 4] and [got["shallow.py", n] for n in "ab"] == [3, 3]
    for i, k in enumerate(indents):
        nxt = next((j for j in range(i + 1, len(indents)) if indents[j] <= k), None)
        assert got["many.py", f"f{i}"] == (nxt if nxt is not None else len(indents) + 1)


def test_scan_diff_tells_findings_of_a_line_apart(lines_of):
    from vigil.operators.summary import scan_diff
    old = api.scan(lines_of({"a.rs": "system(x); exec(y);\nsystem(z);\n", "b.py": "eval(x)\n"}))
    new = api.scan(lines_of({"a.rs": "system(x);\nsystem(z);\n", "b.py": "eval(x)\n", "c.py": "eval(x)\n"}))
    assert (old.filter("path = 'a.rs'").count(), new.filter("path = 'a.rs'").count()) == (3, 2)
    rows = {(r.path, r.line, r.change) for r in scan_diff(old, new).collect()}
    assert rows == {("a.rs", 1, "fixed"), *((r.path, r.line, "added") for r in new.filter("path = 'c.py'").collect())}
    assert scan_diff(old, old).count() == 0
