"""Structural facts: functions, classes, enums (F1-F16, F18) with context (W3, W4) and end lines.

Line-local parts (names, parameters, flags) come from the annotated line row.
Context that the line-by-line reading carried in variables is rebuilt with
skew-safe as-of lookups (vigil.plans.prefix):

* current class (W3): the last class header above the line in the same file
* pending decorators / annotations (W4): each decorator line attaches to the
  next consumer line (class / function header) below it
* end lines: brace depth (running sum over brace events) for brace languages,
  next header at indent <= own for Python
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import catalog as C
from vigil.functions.ids import stable_id
from vigil.functions.text import js_trim
from vigil.operators.lines import is_async_call
from vigil.plans.prefix import asof, running

LINE_SHIFT = 1 << 31          # position = line * 2^31 + index of the brace on the line
LINE_BLOCK = 1024             # lines per block of the blocked scans
ALL_INDENT_BITS = 31          # ranges of indents have up to 2^31 of them
BRACE_LANGUAGES = ("javascript", "typescript", "go", "java", "php")
EOF = "eof"                   # kind of the row that carries a file's number of lines


def _pos_block(pos: Column) -> Column:
    return F.floor(pos / F.lit(LINE_SHIFT * LINE_BLOCK))


def _line_block(line: Column) -> Column:
    return F.floor(line / F.lit(LINE_BLOCK))


def _g(p, i):
    return F.regexp_extract(F.col("trimmed"), p, i)


def _nz(c):
    return F.nullif(c, F.lit(""))


def _split_list(s: Column) -> Column:
    """'A, B' -> ['A', 'B'] (trimmed, empty pieces dropped); null stays null."""
    return F.when(s.isNull(), F.lit(None)).otherwise(
        F.filter(F.transform(F.split(s, ",", -1), lambda x: js_trim(x)), lambda x: x != ""))


# --------------------------------------------------------------- parameters --
_PARAM_T = "array<struct<name:string,type:string,default_value:string,is_optional:boolean,is_variadic:boolean>>"


def _param(name, typ=None, default=None, optional=None, variadic=None):
    nul = F.lit(None)
    return F.struct(name.alias("name"), (typ if typ is not None else nul.cast("string")).alias("type"),
                    (default if default is not None else nul.cast("string")).alias("default_value"),
                    (optional if optional is not None else nul.cast("boolean")).alias("is_optional"),
                    (variadic if variadic is not None else nul.cast("boolean")).alias("is_variadic"))


def parse_params(params: Column, language: Column) -> Column:
    """parameter list text -> array<struct> under each language's rule."""
    parts = F.transform(F.split(params, ",", -1), lambda x: js_trim(x))
    empty = F.array().cast(_PARAM_T)

    def rx(x, p, i):
        return F.regexp_extract(x, p, i)

    py = F.transform(
        F.filter(parts, lambda x: (x != "") & ~x.isin("self", "cls") & x.rlike(C.PY_PARAM)),
        lambda x: _param(rx(x, C.PY_PARAM, 1), js_trim(_nz(rx(x, C.PY_PARAM, 2))),
                         js_trim(_nz(rx(x, C.PY_PARAM, 3))), _nz(rx(x, C.PY_PARAM, 3)).isNotNull(),
                         x.startswith("*")))
    js = F.transform(parts, lambda x: _param(
        js_trim(F.split(x, "=", -1)[0]), None, js_trim(F.get(F.split(x, "=", -1), 1)),
        F.coalesce(F.get(F.split(x, "=", -1), 1) != "", F.lit(False))))
    go = F.transform(F.filter(parts, lambda x: (x != "") & x.rlike(C.GO_PARAM)),
                     lambda x: _param(rx(x, C.GO_PARAM, 1), js_trim(_nz(rx(x, C.GO_PARAM, 2)))))
    java = F.transform(F.filter(parts, lambda x: (x != "") & x.rlike(C.JAVA_PARAM)),
                       lambda x: _param(rx(x, C.JAVA_PARAM, 2),
                                        F.regexp_replace(rx(x, C.JAVA_PARAM, 1), r"^(.*?)\.\.\.", "$1[]"),
                                        None, None, rx(x, C.JAVA_PARAM, 1).contains("...")))
    php = F.transform(F.filter(parts, lambda x: (x != "") & x.rlike(C.PHP_PARAM)),
                      lambda x: _param(rx(x, C.PHP_PARAM, 2), _nz(rx(x, C.PHP_PARAM, 1)),
                                       js_trim(_nz(rx(x, C.PHP_PARAM, 3))),
                                       _nz(rx(x, C.PHP_PARAM, 3)).isNotNull()))
    ts_parts = F.filter(ts_split_params(params), lambda x: js_trim(x) != "")
    ts = F.transform(F.filter(F.transform(ts_parts, lambda x: js_trim(x)), lambda x: x.rlike(C.TS_PARAM)),
                     lambda x: _param(rx(x, C.TS_PARAM, 2), js_trim(_nz(rx(x, C.TS_PARAM, 4))),
                                      js_trim(_nz(rx(x, C.TS_PARAM, 5))),
                                      (rx(x, C.TS_PARAM, 3) != "") | (rx(x, C.TS_PARAM, 5) != ""),
                                      rx(x, C.TS_PARAM, 1) != ""))
    res = (F.when(language == "python", py).when(language == "javascript", js)
           .when(language == "typescript", ts).when(language == "go", go)
           .when(language == "java", java).when(language == "php", php).otherwise(empty))
    return F.when(js_trim(params) == "", empty).otherwise(res)


def ts_split_params(params: Column) -> Column:
    """Pieces between commas, joined again until their brackets balance ('<([{' open, '>)]}' close)."""
    pieces = F.transform(F.split(params, ",", -1), lambda p: F.struct(
        p.alias("text"), (F.length(F.regexp_replace(p, r"[^<(\[{]", "")) - F.length(F.regexp_replace(p, r"[^>)\]}]", "")))
        .alias("balance")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"),
                     F.lit(0).alias("balance"))

    def join(acc, p):
        text = F.concat_ws(",", acc["open"], p["text"])
        balance = acc["balance"] + p["balance"]
        closed = balance == 0
        return F.struct(F.when(closed, F.concat(acc["done"], F.array(text))).otherwise(acc["done"]).alias("done"),
                        F.when(~closed, text).alias("open"), balance.alias("balance"))

    return F.aggregate(pieces, start, join, lambda acc: F.when(acc["open"].isNull(), acc["done"])
                       .otherwise(F.concat(acc["done"], F.array(acc["open"]))))


# ------------------------------------------------------------ fact lines --
def is_function_line() -> Column:
    L, k = F.col("language"), F.col("kind")
    return ((L.isin("python", "go", "php") & (k == "function")) | (L.isin("javascript", "typescript") & k.isin("function", "arrow"))
            | ((L == "java") & (k == "method")))


def _is_header_class() -> Column:
    L, k = F.col("language"), F.col("kind")
    return L.isin(*C.PARSED_LANGUAGES) & ((k == "class") | ((L == "go") & k.isin("struct", "interface"))
                                          | ((L == "java") & (k == "interface")))


def _is_ts_interface() -> Column:
    return (F.col("language") == "typescript") & F.col("trimmed").rlike(C.TS_INTERFACE)


def is_class_line() -> Column:
    """Rows that a line adds to the class table (a TypeScript line may add two)."""
    return _is_header_class().cast("int") + _is_ts_interface().cast("int")


def _is_python_header() -> Column:
    t = F.col("trimmed")
    return (F.col("language") == "python") & (t.startswith("def ") | t.startswith("async def ") | t.startswith("class "))


def with_braces(annotated: DataFrame) -> DataFrame:
    return annotated.withColumn("braces", F.when(F.col("language").isin(*BRACE_LANGUAGES),
                                                 F.regexp_replace("text", r"[^{}]", "")).otherwise(""))


def fact_fields() -> tuple[Column, list[Column]]:
    """Of lines with_braces(): which ones structure tables are made of, and what of them (kind, indent, trimmed, braces)."""
    head = (is_function_line() | _is_header_class() | _is_ts_interface() | _is_python_header()
            | F.col("kind").isin("decorator", "annotation"))
    fields = [F.col("kind"), F.col("indent"), F.when(head, F.col("trimmed")).otherwise("").alias("trimmed"), F.col("braces")]
    return head | (F.col("braces") != ""), fields


def file_ends(lines: DataFrame) -> DataFrame:
    """One row per file of kind EOF at its last line."""
    return lines.groupBy("path", "language").agg(F.max("line").alias("line")).withColumn("kind", F.lit(EOF))


def fact_lines(annotated: DataFrame, with_calls: bool = False) -> DataFrame:
    """The lines that structure tables are made of, without the text of any other.

    Headers, decorators and annotations with their trimmed text, lines with
    braces as the braces alone, calls if asked for, and one row per file of
    kind EOF at its last line.
    """
    a = with_braces(annotated)
    keep, fields = fact_fields()
    if with_calls:
        keep = keep | (F.size("calls") > 0)
        # a call's language flag needs no more of its line than whether it is asynchronous
        fields += [F.col("calls"), is_async_call().alias("async_call")]
    # kept rows are generated, not filtered: a filter would be pushed down with a copy of the line-kind
    # chain for every mention of kind
    lines = a.select("path", "language", "line", F.inline(F.when(keep, F.array(F.struct(*fields)))))
    return lines.unionByName(file_ends(annotated), allowMissingColumns=True)


# ----------------------------------------------------------- header rows --
def _function_rows(a: DataFrame) -> DataFrame:
    L = F.col("language")
    k = F.col("kind")
    f = a.filter(is_function_line())
    name = (F.when(L == "python", _g(C.PY_FUNCTION, 1))
            .when(L.isin("javascript", "typescript") & (k == "function"), _g(C.JS_FUNCTION, 1))
            .when(L.isin("javascript", "typescript"), _g(C.JS_ARROW, 1))
            .when(L == "go", _g(C.GO_FUNCTION, 3))
            .when(L == "java", _g(C.JAVA_METHOD, 2))
            .otherwise(_g(C.PHP_FUNCTION, 1)))
    params = (F.when(L == "python", _g(C.PY_FUNCTION, 2))
              .when(L.isin("javascript", "typescript") & (k == "function"), _g(C.JS_FUNCTION, 2))
              .when(L.isin("javascript", "typescript"), F.lit(""))
              .when(L == "go", _g(C.GO_FUNCTION, 4))
              .when(L == "java", _g(C.JAVA_METHOD, 3))
              .otherwise(_g(C.PHP_FUNCTION, 2)))
    ret = (F.when(L == "python", _nz(_g(C.PY_FUNCTION, 3)))
           .when(L == "go", _nz(_g(C.GO_FUNCTION, 5)))
           .when(L == "java", _g(C.JAVA_METHOD, 1)))
    is_async = (F.when(L == "python", _g(C.PY_FUNCTION, 0).contains("async "))
                .when(L.isin("javascript", "typescript"), F.col("trimmed").contains("async ")))
    return f.select("path", "language", "line", "indent", "kind", name.alias("name"), params.alias("params_text"),
                    ret.alias("return_type"), is_async.alias("is_async"), "trimmed")


def _class_rows(a: DataFrame) -> DataFrame:
    """Class-like headers: classes, Go structs/interfaces, Java interfaces (brace end lines apply)."""
    L = F.col("language")
    k = F.col("kind")
    c = a.filter(_is_header_class())
    name = (F.when(L == "python", _g(C.PY_CLASS, 1))
            .when(L.isin("javascript", "typescript"), _g(C.JS_CLASS, 1))
            .when((L == "go") & (k == "struct"), _g(C.GO_STRUCT, 1))
            .when(L == "go", _g(C.GO_INTERFACE, 1))
            .when((L == "java") & (k == "class"), _g(C.JAVA_CLASS, 1))
            .when(L == "java", _g(C.JAVA_INTERFACE, 1))
            .otherwise(_g(C.PHP_CLASS, 1)))
    py_parents = F.when(_g(C.PY_CLASS, 2) == "", F.array().cast("array<string>")).otherwise(_split_list(_g(C.PY_CLASS, 2)))
    parent = (F.when(L == "python", F.get(py_parents, 0))
              .when(L.isin("javascript", "typescript"), _nz(_g(C.JS_CLASS, 2)))
              .when((L == "java") & (k == "class"), _nz(_g(C.JAVA_CLASS, 2)))
              .when(L == "php", _nz(_g(C.PHP_CLASS, 2))))
    interfaces = (F.when(L == "python", F.slice(py_parents, F.lit(2), F.greatest(F.size(py_parents), F.lit(1))))
                  .when((L == "java") & (k == "class"), _split_java(_nz(_g(C.JAVA_CLASS, 3))))
                  .when(L == "java", _split_java(_nz(_g(C.JAVA_INTERFACE, 2))))
                  .when(L == "php", _split_java(_nz(_g(C.PHP_CLASS, 3)))))
    ckind = F.when(k.isin("struct", "interface"), k).otherwise(F.lit("class"))
    return c.select("path", "language", "line", "indent", "kind", ckind.alias("class_kind"), name.alias("name"),
                    parent.alias("parent_class"), interfaces.alias("interfaces"))


def _split_java(s: Column) -> Column:
    """'A, B' -> ['A', 'B'] keeping empty pieces (split(',').map(trim)); null stays null."""
    return F.when(s.isNull(), F.lit(None)).otherwise(F.transform(F.split(s, ",", -1), lambda x: js_trim(x)))


def _ts_interfaces(a: DataFrame) -> DataFrame:
    """TypeScript interfaces: any line (comments included) -> class-like rows without end-line search."""
    d = a.filter(_is_ts_interface())
    return d.select("path", "language", "line", "indent", F.lit("interface").alias("kind"),
                    F.lit("interface").alias("class_kind"), _g(C.TS_INTERFACE, 1).alias("name"),
                    _nz(_g(C.TS_INTERFACE, 2)).alias("parent_class"),
                    F.lit(None).cast("array<string>").alias("interfaces"))


def enums(a: DataFrame) -> DataFrame:
    """F8: TypeScript enums as variables(path, line, name, type, is_constant, is_exported)."""
    d = a.filter((F.col("language") == "typescript") & F.col("trimmed").rlike(C.TS_ENUM))
    return d.select("path", "language", "line", _g(C.TS_ENUM, 1).alias("name"), F.lit("enum").alias("type"),
                    F.lit(True).alias("is_constant"), F.col("trimmed").startswith("export").alias("is_exported"))


# -------------------------------------------------------------- context ----
def _attach_class(rows: DataFrame, a: DataFrame) -> DataFrame:
    """class_name / class_line = last class header above (Python, Java classes, PHP)."""
    L = F.col("language")
    heads = a.filter((L.isin("python", "php") & (F.col("kind") == "class"))
                     | ((L == "java") & (F.col("kind") == "class")))
    heads = heads.select("path", F.col("line").alias("cline"),
                         F.struct(F.col("line").alias("line"),
                                  F.when(L == "python", _g(C.PY_CLASS, 1))
                                  .when(L == "java", _g(C.JAVA_CLASS, 1))
                                  .otherwise(_g(C.PHP_CLASS, 1)).alias("name")).alias("v"))
    return asof(rows, heads, ["path"], F.col("line").cast("long"), F.col("cline").cast("long"), F.col("v"),
                "_cls", _line_block, direction="backward", strict=True)


def _pending(a: DataFrame) -> DataFrame:
    """Decorator (Python) / annotation (Java) names grouped by the consumer line they attach to."""
    L = F.col("language")
    k = F.col("kind")
    dec = a.filter(((L == "python") & (k == "decorator") & F.col("trimmed").rlike(C.PY_DECORATOR))
                   | ((L == "java") & (k == "annotation")))
    dec = dec.select("path", "line", F.when(L == "python", _g(C.PY_DECORATOR, 1))
                     .otherwise(_g(C.JAVA_ANNOTATION, 1)).alias("dname"))
    consumers = a.filter(((L == "python") & k.isin("class", "function")) | ((L == "java") & k.isin("class", "method")))
    consumers = consumers.select("path", F.col("line").alias("cl"))
    att = asof(dec, consumers, ["path"], F.col("line").cast("long"), F.col("cl").cast("long"), F.col("cl"),
               "consumer", _line_block, direction="forward", strict=True)
    att = att.filter(F.col("consumer").isNotNull())
    return att.groupBy("path", "consumer").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line", "dname"))), lambda s: s["dname"]).alias("decorators"))


# ------------------------------------------------------------- end lines ---
def _n_lines(a: DataFrame) -> DataFrame:
    return a.filter(F.col("kind") == EOF).select("path", F.col("line").alias("n_lines"))


def brace_end_lines(a: DataFrame, heads: DataFrame) -> DataFrame:
    """end line = line of the first '}' after the header start that brings depth back to the
    depth before the header line; file end when none.  heads: (path, line) unique."""
    ev = (a.filter(F.col("braces") != "").select("path", "line", F.posexplode(F.split("braces", "")).alias("i", "ch"))
          .filter("ch <> ''")
          .select("path", (F.col("line").cast("long") * LINE_SHIFT + F.col("i")).alias("pos"),
                  F.when(F.col("ch") == "{", 1).otherwise(-1).alias("delta")))
    ev = running(ev, ["path"], ["pos"], _pos_block(F.col("pos")), F.col("delta"), "depth", how="sum")
    h = heads.select("path", "line")
    h = asof(h, ev, ["path"], F.col("line").cast("long") * LINE_SHIFT, F.col("pos"), F.col("depth"), "d0",
             _pos_block, direction="backward", strict=True)
    h = h.withColumn("d0", F.coalesce(F.col("d0"), F.lit(0).cast("long")))
    closes = ev.filter(F.col("delta") == -1).select("path", "pos", F.col("depth").alias("d0"))
    h = asof(h, closes, ["path", "d0"], F.col("line").cast("long") * LINE_SHIFT - 1, F.col("pos"), F.col("pos"),
             "end_pos", _pos_block, direction="forward", strict=True)
    return h.select("path", "line", F.floor(F.col("end_pos") / LINE_SHIFT).cast("int").alias("end_line"))


def python_end_lines(a: DataFrame, heads: DataFrame) -> DataFrame:
    """end line = (next header line below with indent <= own) - 1; file end when none.

    Header candidates are non-blank, non-comment lines starting with 'def ',
    'async def ' or 'class '.  "Indent <= own" is a range of indents: a header
    asks the few dyadic ranges that make up [0, own], a candidate enters those
    around its indent that are of a size that a header of its file asks for.
    Each is an as-of lookup on (path, range), so headers are never paired,
    however many indents a file has.
    """
    own = F.col("indent").cast("long")
    asked = heads.groupBy("path").agg(F.bit_or(own + 1).alias("_asked"))

    def levels(mask):
        return F.explode(F.filter(F.array(*[F.lit(k) for k in range(ALL_INDENT_BITS + 1)]), lambda k: F.getbit(mask, k) == 1))
    cand = a.filter(_is_python_header()).select("path", F.col("line").cast("long").alias("cline"), F.col("indent").cast("long").alias("_i"))
    cand = cand.join(asked, "path").withColumn("level", levels(F.col("_asked")))
    cand = cand.select("path", "cline", "level", F.expr("shiftright(_i, level)").alias("node"))
    q = heads.select("path", "line", own.alias("_i"), levels(own + 1).alias("level"))
    q = q.select("path", "line", "level", (F.expr("shiftright(_i + 1, level)") - 1).alias("node"))
    r = asof(q, cand, ["path", "level", "node"], F.col("line").cast("long"), F.col("cline"), F.col("cline"), "next_line",
             _line_block, direction="forward", strict=True)
    return r.groupBy("path", "line").agg((F.min("next_line") - 1).cast("int").alias("end_line"))


def _with_end_lines(rows: DataFrame, a: DataFrame) -> DataFrame:
    """Add end_line to header rows (path, language, line, indent, ...)."""
    py = rows.filter(F.col("language") == "python")
    br = rows.filter(F.col("language") != "python")
    pe = python_end_lines(a, py.select("path", "line", "indent").distinct())
    be = brace_end_lines(a, br.select("path", "line").distinct())
    ends = pe.unionByName(be)
    n = _n_lines(a)
    out = rows.join(ends, ["path", "line"], "left").join(n, ["path"], "left")
    return out.withColumn("end_line", F.coalesce(F.col("end_line"), F.col("n_lines"))).drop("n_lines")


# ------------------------------------------------------------- tables ------
def functions_table(a: DataFrame, with_params: bool = True) -> DataFrame:
    """Of fact_lines: functions(fn_id, path, language, name, line, end_line, return_type, is_async, is_exported,
    is_method, class_name, class_line, decorators, parameters)."""
    f = _function_rows(a)
    f = _attach_class(f, a)
    dec = _pending(a)
    f = f.join(dec.withColumnRenamed("consumer", "line"), ["path", "line"], "left")
    f = _with_end_lines(f, a)
    L = F.col("language")
    go_recv = F.regexp_extract(F.col("trimmed"), C.GO_FUNCTION, 2)
    cls = F.col("_cls")
    is_method = (F.when(L.isin("python", "php"), cls.isNotNull())
                 .when(L == "go", go_recv != "")
                 .when(L == "java", F.lit(True))
                 .otherwise(F.lit(False)))
    class_name = (F.when(L.isin("python", "php", "java"), cls["name"])
                  .when(L == "go", _nz(go_recv)))
    first = F.substring(F.col("name"), 1, 1)
    exported = (F.when(L == "python", F.coalesce(F.array_contains(F.col("decorators"), "export"), F.lit(False))
                       | F.col("name").startswith("test_"))
                .when(L.isin("javascript", "typescript") & (F.col("kind") == "function"), F.col("trimmed").startswith("export"))
                .when(L == "go", first == F.upper(first))
                .when(L == "java", F.col("trimmed").contains("public"))
                .when(L == "php", F.col("name").startswith("__") | F.col("trimmed").contains("public")))
    # methods of a class: Python only indented defs, Java/PHP every function after the header
    method_of = (F.when((L == "python") & (F.col("indent") > 0), cls["line"])
                 .when(L.isin("java", "php"), cls["line"]))
    cols = [stable_id("func", F.col("path"), F.col("line")).alias("fn_id"), "path", "language", "name", "line",
            "end_line", "return_type", "is_async", exported.alias("is_exported"), is_method.alias("is_method"),
            class_name.alias("class_name"), method_of.alias("method_of_line"),
            F.when(L == "python", F.col("decorators")).alias("decorators")]
    if with_params:
        cols.append(parse_params(F.col("params_text"), L).alias("parameters"))
    return f.select(*cols)


def classes_table(a: DataFrame) -> DataFrame:
    """Of fact_lines: classes(class_id, path, language, kind, name, line, end_line, parent_class, interfaces, decorators)."""
    c = _class_rows(a)
    dec = _pending(a)
    c = c.join(dec.withColumnRenamed("consumer", "line"), ["path", "line"], "left")
    c = _with_end_lines(c, a)
    ts = _ts_interfaces(a).withColumn("decorators", F.lit(None).cast("array<string>")) \
        .withColumn("end_line", F.col("line"))
    allc = c.unionByName(ts)
    return allc.select(stable_id("class", F.col("class_kind"), F.col("path"), F.col("line")).alias("class_id"),
                       "path", "language", F.col("class_kind").alias("kind"), "name", "line", "end_line",
                       "parent_class", "interfaces", "decorators")
