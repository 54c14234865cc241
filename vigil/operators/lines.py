"""Line model: explode files into lines, classify each line, extract line-local facts.

Everything here is a narrow transformation (no shuffle): the kind of a line,
its calls and its imports depend only on the line's own text and the file's
language.  The precedence inside a line is first-match-wins, written as one
``when`` chain, and calls exist only on lines of kind 'other'.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import catalog as C
from vigil.functions.memo import per_session
from vigil.functions.text import js_trim, leading_ws





def LANG():
    return F.col("language")

def T():
    return F.col("trimmed")


def explode_lines(files: DataFrame, context: int | None = None, keep=None) -> DataFrame:
    """source_files(path, language, content) -> code_lines(path, language, line, text).

    Split on '\\n' only (a CR stays in the line); trailing empty pieces are kept.
    ``keep``(text, language) is a condition on the lines wanted.  With
    ``context``, every line also carries its snippet, cut from the file's own
    row, so snippets need no shuffle; only lines that are kept have one cut.
    """
    pieces = F.split(F.col("content"), "\n", -1)
    if context is None:
        x = files.select("path", "language", F.posexplode(pieces).alias("_pos", "text")) \
            .select("path", "language", (F.col("_pos") + 1).cast("int").alias("line"), "text")
        return x if keep is None else x.filter(keep(F.col("text"), F.col("language")))
    from vigil.operators.finalize import snippet_struct
    x = files.select("path", "language", pieces.alias("_p"))
    first = lambda i: F.greatest(i - F.lit(context), F.lit(0))
    around = lambda t, i: F.struct(t.alias("text"), i.alias("pos"), first(i).alias("first"), F.array_join(
        F.slice("_p", first(i) + 1, i + F.lit(context) + 1 - first(i)), "\n").alias("code"))
    if keep is None:
        lines = F.transform("_p", around)
    else:
        lines = F.filter(F.transform("_p", lambda t, i: F.when(keep(t, F.col("language")), around(t, i))), lambda s: s.isNotNull())
    x = x.select("path", "language", F.explode(lines).alias("l"))
    line = (F.col("l.pos") + 1).cast("int")
    return x.select("path", "language", line.alias("line"), F.col("l.text").alias("text"),
                    snippet_struct(F.col("l.code"), F.col("language"), F.col("l.first") + 1, line).alias("snippet"))


def _starts_any(c: Column, prefixes) -> Column:
    out = None
    for p in prefixes:
        t = c.startswith(p)
        out = t if out is None else (out | t)
    return out


def _rx(p: str) -> Column:
    return T().rlike(p)


def _g(p: str, i: int) -> Column:
    return F.regexp_extract(T(), p, i)


def _nz(c: Column) -> Column:
    """'' (non-participating group) -> null."""
    return F.nullif(c, F.lit(""))


@per_session
def line_kind() -> Column:
    """Kind of a line under its language's fact rules."""
    blank = T() == ""
    py = (F.when(blank | T().startswith("#"), "skip")
          .when(T().startswith("@"), "decorator")
          .when(_rx(C.PY_CLASS), "class")
          .when(_rx(C.PY_FUNCTION), "function")
          .when(_rx(C.PY_IMPORT), "import")
          .when(_rx(C.PY_FROM_IMPORT), "from_import")
          .otherwise("other"))
    js = (F.when(blank | _starts_any(T(), ["//", "/*"]), "skip")
          .when(_rx(C.JS_CLASS), "class")
          .when(_rx(C.JS_FUNCTION), "function")
          .when(_rx(C.JS_ARROW), "arrow")
          .when(_rx(C.JS_IMPORT_ES6), "import")
          .when(_rx(C.JS_REQUIRE), "require")
          .otherwise("other"))
    go = (F.when(blank | T().startswith("//"), "skip")
          .when(_rx(C.GO_FUNCTION), "function")
          .when(_rx(C.GO_STRUCT), "struct")
          .when(_rx(C.GO_INTERFACE), "interface")
          .when(T().startswith("import"), "import")
          .otherwise("other"))
    java_method = _rx(C.JAVA_METHOD) & ~T().contains("new ") & ~T().contains("return ")
    java = (F.when(blank | _starts_any(T(), ["//", "/*"]), "skip")
            .when(T().startswith("@") & _rx(C.JAVA_ANNOTATION), "annotation")
            .when(_rx(C.JAVA_CLASS), "class")
            .when(_rx(C.JAVA_INTERFACE), "interface")
            .when(java_method & _g(C.JAVA_METHOD, 2).isin(C.JAVA_METHOD_SKIP_NAMES), "skip")
            .when(java_method, "method")
            .when(_rx(C.JAVA_IMPORT), "import")
            .otherwise("other"))
    php = (F.when(blank | _starts_any(T(), ["//", "#", "/*"]), "skip")
           .when(_rx(C.PHP_CLASS), "class")
           .when(_rx(C.PHP_FUNCTION), "function")
           .when(_rx(C.PHP_USE), "import")
           .otherwise("other"))
    return (F.when(LANG() == "python", py)
            .when(LANG().isin("javascript", "typescript"), js)
            .when(LANG() == "go", go)
            .when(LANG() == "java", java)
            .when(LANG() == "php", php)
            .otherwise("unparsed"))


@per_session
def _calls() -> Column:
    """array<struct<name, arguments, ord>> of the calls on an 'other' line."""
    def extract(pat):
        return F.arrays_zip(F.regexp_extract_all(T(), F.lit(pat), 1).alias("name"),
                            F.regexp_extract_all(T(), F.lit(pat), 2).alias("args"))
    pairs = F.when(LANG() == "php", extract(C.PHP_CALL_PATTERN)).otherwise(extract(C.CALL_PATTERN))
    indexed = F.transform(pairs, lambda p, i: F.struct(p["name"].alias("name"), p["args"].alias("args"),
                                                      i.alias("ord")))

    def keep(c):
        n = c["name"]
        java_skip = None
        for k in C.CALL_KEYWORDS["java"]:
            t = n.startswith(k)
            java_skip = t if java_skip is None else (java_skip | t)
        return (F.when(LANG().isin("javascript", "typescript"), ~n.isin(C.CALL_KEYWORDS["javascript"]))
                .when(LANG() == "go", ~n.isin(C.CALL_KEYWORDS["go"]))
                .when(LANG() == "php", ~n.isin(C.CALL_KEYWORDS["php"]))
                .when(LANG() == "java", ~java_skip)
                .otherwise(F.lit(True)))
    kept = F.filter(indexed, keep)
    return F.transform(kept, lambda c: F.struct(
        c["name"].alias("name"),
        F.when(c["args"] == "", F.array().cast("array<string>"))
         .otherwise(F.transform(F.split(c["args"], ",", -1), lambda a: js_trim(a))).alias("arguments"),
        c["ord"].alias("ord")))


_IMPORT_T = "array<struct<name:string,from:string,alias:string,is_default:boolean,is_namespace:boolean>>"


def _imp(name, frm, alias=None, is_default=False, is_namespace=False) -> Column:
    return F.struct(name.alias("name"), frm.alias("from"),
                    (alias if alias is not None else F.lit(None).cast("string")).alias("alias"),
                    F.lit(is_default).alias("is_default"), F.lit(is_namespace).alias("is_namespace"))


def _named_list(s: Column, frm: Column, keep_empty: bool) -> Column:
    """'a, b as c' -> array of import structs (split on ',' then on ' as ')."""
    parts = F.transform(F.split(s, ",", -1), lambda x: js_trim(x))
    if not keep_empty:
        parts = F.filter(parts, lambda x: js_trim(F.split(x, r"\s+as\s+", -1)[0]) != "")
    return F.transform(parts, lambda x: _imp(
        js_trim(F.split(x, r"\s+as\s+", -1)[0]), frm,
        js_trim(F.get(F.split(x, r"\s+as\s+", -1), 1))))


@per_session
def _imports() -> Column:
    """array of import structs found on an import line."""
    empty = F.array().cast(_IMPORT_T)
    kind = F.col("kind")
    py_import = F.array(_imp(_g(C.PY_IMPORT, 1), _g(C.PY_IMPORT, 1), _nz(_g(C.PY_IMPORT, 2)), False, True))
    py_from = _named_list(_g(C.PY_FROM_IMPORT, 2), _g(C.PY_FROM_IMPORT, 1), keep_empty=True)
    es6_from = _g(C.JS_IMPORT_ES6, 4)
    es6_default = F.when(_g(C.JS_IMPORT_ES6, 2) != "",
                         F.array(_imp(_g(C.JS_IMPORT_ES6, 2), es6_from, None, True, False))).otherwise(empty)
    named_src = F.coalesce(_nz(_g(C.JS_IMPORT_ES6, 1)), _nz(_g(C.JS_IMPORT_ES6, 3)))
    es6_named = F.when(named_src.isNotNull(), _named_list(named_src, es6_from, keep_empty=False)).otherwise(empty)
    js_require = F.array(_imp(_g(C.JS_REQUIRE, 1), _g(C.JS_REQUIRE, 1), None, False, True))
    go_single = F.when(_g(C.GO_IMPORT, 2) != "",
                       F.array(_imp(_g(C.GO_IMPORT, 2), _g(C.GO_IMPORT, 2), None, False, True))).otherwise(empty)
    jg = _g(C.JAVA_IMPORT, 1)
    java_last = F.element_at(F.split(jg, r"\.", -1), -1)
    java_imp = F.array(_imp(F.when(java_last != "", java_last).otherwise(jg), jg, None, False, False))
    pg = _g(C.PHP_USE, 1)
    php_last = F.element_at(F.split(pg, r"\\", -1), -1)
    php_name = F.coalesce(_nz(_g(C.PHP_USE, 2)), F.when(php_last != "", php_last).otherwise(pg))
    php_imp = F.array(_imp(php_name, pg, _nz(_g(C.PHP_USE, 2)), False, False))
    return (F.when((LANG() == "python") & (kind == "import"), py_import)
            .when((LANG() == "python") & (kind == "from_import"), py_from)
            .when(LANG().isin("javascript", "typescript") & (kind == "import"), F.concat(es6_default, es6_named))
            .when(LANG().isin("javascript", "typescript") & (kind == "require"), js_require)
            .when((LANG() == "go") & (kind == "import"), go_single)
            .when((LANG() == "java") & (kind == "import"), java_imp)
            .when((LANG() == "php") & (kind == "import"), php_imp)
            .otherwise(empty))


def annotate(lines: DataFrame) -> DataFrame:
    """code_lines -> lines with trimmed, indent, kind, calls, imports (all row-local)."""
    d = lines.withColumn("trimmed", js_trim(F.col("text"))).withColumn("kind", line_kind())
    return (d.withColumn("indent", leading_ws(F.col("text")).cast("int"))
             .withColumn("calls", F.when(F.col("kind") == "other", _calls())
                         .otherwise(F.array().cast("array<struct<name:string,arguments:array<string>,ord:int>>")))
             .withColumn("imports", _imports()))


def is_async_call() -> Column:
    return (F.col("language") == "go") & (F.col("trimmed").contains("go ") | F.col("trimmed").contains("defer "))


def calls_table(annotated: DataFrame) -> DataFrame:
    """calls(path, language, line, call_ord, name, callee, arguments, is_async) of annotated or fact lines."""
    flag = F.col("async_call") if "async_call" in annotated.columns else is_async_call()
    x = annotated.select("path", "language", "line", flag.alias("is_async"), F.posexplode("calls").alias("call_ord", "c"))
    return x.select("path", "language", "line", F.col("call_ord").cast("int").alias("call_ord"),
                    F.col("c.name").alias("name"), F.col("c.name").alias("callee"),
                    F.col("c.arguments").alias("arguments"), "is_async")


def imports_table(annotated: DataFrame) -> DataFrame:
    """imports(path, language, line, import_ord, name, from, alias, is_default, is_namespace)."""
    x = annotated.select("path", "language", "line", F.posexplode("imports").alias("import_ord", "i"))
    return x.select("path", "language", "line", F.col("import_ord").cast("int").alias("import_ord"),
                    "i.name", F.col("i.from").alias("from"), "i.alias", "i.is_default", "i.is_namespace")
