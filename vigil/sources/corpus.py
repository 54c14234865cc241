"""Templated code corpus derived from the ``events`` table.

Every user's events become one source file; the n-th event of a user
(ordered by event_id) becomes line n, rendered from a fixed 10-line template
chosen by ``user_id % 6``.  The same generation rule is written in SQL for
the DuckDB oracle, so results over this corpus are checkable at every scale.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.plans.prefix import running

# FIXED VALUES: corpus templates (k, language, ext, slot, template)
TEMPLATES = [
    (0, "python", "py", 0, "class Svc{b}(Base):"),
    (0, "python", "py", 1, "    @route('/r')"),
    (0, "python", "py", 2, "    def h{u}_{b}(self, q, n=1):"),
    (0, "python", "py", 3, "        v = request.args.get('q')"),
    (0, "python", "py", 4, '        sql = f"SELECT * FROM t WHERE id = {v}"'),
    (0, "python", "py", 5, "        os.system(request.args.get('c'))"),
    (0, "python", "py", 6, '        password = "pw{id}abc"'),
    (0, "python", "py", 7, "        return pickle.loads(v)"),
    (0, "python", "py", 8, "import pickle"),
    (0, "python", "py", 9, "x = h{u}_{b}(v) + hashlib.md5(v)"),
    (1, "javascript", "js", 0, "class Svc{b} extends Base {"),
    (1, "javascript", "js", 1, "function h{u}_{b}(req, res = 1) {"),
    (1, "javascript", "js", 2, "  const q = req.query.q;"),
    (1, "javascript", "js", 3, "  exec(req.query.cmd);"),
    (1, "javascript", "js", 4, '  el.innerHTML = q + "{id}";'),
    (1, "javascript", "js", 5, "  fetch(url{id}); h{u}_0(q);"),
    (1, "javascript", "js", 6, "}"),
    (1, "javascript", "js", 7, 'const apiKey = "k{id}abcdef";'),
    (1, "javascript", "js", 8, "import { a, b as c } from 'child_process';"),
    (1, "javascript", "js", 9, "eval(q); h{u}_{b}(q);"),
    (2, "typescript", "ts", 0, "export interface I{b} extends Base {"),
    (2, "typescript", "ts", 1, "}"),
    (2, "typescript", "ts", 2, "export enum E{b} { A }"),
    (2, "typescript", "ts", 3, "function h{u}_{b}(x: Map<string, number>, y?: string) {"),
    (2, "typescript", "ts", 4, "  document.write(request.query.q);"),
    (2, "typescript", "ts", 5, "  axios.get(url{id}); h{u}_0(q);"),
    (2, "typescript", "ts", 6, "}"),
    (2, "typescript", "ts", 7, "import def from 'vm';"),
    (2, "typescript", "ts", 8, 'response.redirect(base + "{id}");'),
    (2, "typescript", "ts", 9, "h{u}_{b}(q);"),
    (3, "go", "go", 0, "type S{b} struct {"),
    (3, "go", "go", 1, "}"),
    (3, "go", "go", 2, "func (s *S{b}) H{b}(a string, n int) {"),
    (3, "go", "go", 3, '  exec.Command(r.FormValue("c"))'),
    (3, "go", "go", 4, "  http.Get(url{id})"),
    (3, "go", "go", 5, "  go H{b}(a)"),
    (3, "go", "go", 6, "}"),
    (3, "go", "go", 7, 'import "os/exec"'),
    (3, "go", "go", 8, 'os.Open(base + "{id}")'),
    (3, "go", "go", 9, "H{b}(a)"),
    (4, "java", "java", 0, "public class S{b} extends Base implements A, B {"),
    (4, "java", "java", 1, "@Deprecated"),
    (4, "java", "java", 2, "public String h{u}_{b}(String a, int... n) {"),
    (4, "java", "java", 3, '  String q = String.format("SELECT %s", a);'),
    (4, "java", "java", 4, '  runtime.exec(request.getParameter("c"));'),
    (4, "java", "java", 5, "  DocumentBuilder b{id} = h{u}_0(a);"),
    (4, "java", "java", 6, "}"),
    (4, "java", "java", 7, "import java.io.ObjectInputStream;"),
    (4, "java", "java", 8, 'Cipher.getInstance("DES/ECB/PKCS5Padding");'),
    (4, "java", "java", 9, "h{u}_{b}(a);"),
    (5, "php", "php", 0, "class S{b} extends Base implements A {"),
    (5, "php", "php", 1, "public function h{u}_{b}(string $a, $n = 1) {"),
    (5, "php", "php", 2, "  $x = $_GET['c'];"),
    (5, "php", "php", 3, "  shell_exec($_GET['c']);"),
    (5, "php", "php", 4, "  include_once(file_get_contents($url{id}));"),
    (5, "php", "php", 5, "  unserialize($x); h{u}_0($x);"),
    (5, "php", "php", 6, "}"),
    (5, "php", "php", 7, "use App\\Models\\User as U;"),
    (5, "php", "php", 8, "$password = 'pw{id}xyz';"),
    (5, "php", "php", 9, "h{u}_{b}($x);"),
]

# events per block of the per-user line numbering (bounds every window partition)
EVENT_BLOCK = 1 << 16


# FIXED VALUES: templates of the call corpus (slot, template); {p} is half the user's id, {n} the next id of its eight
CALL_TEMPLATES = [
    (0, "def get{u}_{b}(q):"),
    (1, "    v = request.args.get('q{id}')"),
    (2, "    return v"),
    (3, "def relay{u}_{b}(a, n=1):"),
    (4, "    t = {call}{p}_{b}(a)"),
    (5, "    save{p}_{b}(t, n)"),
    (6, "    return t"),
    (7, "def save{u}_{b}(row, n):"),
    (8, "    save{p}_{b}(row + n)"),
    (9, "    db.execute(row)"),
    (10, "def loop{u}_{b}(x):"),
    (11, "    loop{n}_{b}(x)"),
]


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "k int, language string, ext string, slot int, template string")


def corpus_lines(events: DataFrame) -> DataFrame:
    """code_lines(path, language, line, text) of the templated corpus.

    Line number = rank of the event within its user by event_id, computed
    with a blocked running count (a hot user does not serialise the job).
    The 60-row template table is a broadcast join side of fixed size.
    """
    spark = events.sparkSession
    ev = events.select("event_id", "user_id")
    ranked = running(ev, ["user_id"], ["event_id"], F.floor(F.col("event_id") / EVENT_BLOCK),
                     F.lit(1), "rn", how="sum", inclusive=True)
    t = F.broadcast(template_table(spark))
    j = ranked.join(t, (F.col("user_id") % 6 == t["k"]) & (((F.col("rn") - 1) % 10) == t["slot"]))
    b = F.floor((F.col("rn") - 1) / 10).cast("long").cast("string")
    text = F.replace(F.replace(F.replace(F.col("template"), F.lit("{id}"), F.col("event_id").cast("string")),
                               F.lit("{u}"), F.col("user_id").cast("string")), F.lit("{b}"), b)
    return j.select(
        F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit("."), F.col("ext")).alias("path"),
        F.col("language"),
        F.col("rn").cast("int").alias("line"),
        text.alias("text"),
    )


def call_lines(events: DataFrame) -> DataFrame:
    """code_lines of a corpus whose files call each other: chains of halved user ids, rings of eight users.

    One Python file per user; values come back through returns (of users with
    an even id from ``get``, else from another ``relay``) and go on through
    parameters.  Line numbers as in corpus_lines.
    """
    spark = events.sparkSession
    ranked = running(events.select("event_id", "user_id"), ["user_id"], ["event_id"], F.floor(F.col("event_id") / EVENT_BLOCK),
                     F.lit(1), "rn", how="sum", inclusive=True)
    n = len(CALL_TEMPLATES)
    t = F.broadcast(spark.createDataFrame(CALL_TEMPLATES, "slot int, template string"))
    j = ranked.join(t, (F.col("rn") - 1) % n == t["slot"])
    u = F.col("user_id")
    text = F.col("template")
    for key, value in (("{id}", F.col("event_id")), ("{u}", u), ("{b}", F.floor((F.col("rn") - 1) / n)), ("{p}", F.floor(u / 2)),
                       ("{n}", u - u % 8 + (u + 1) % 8), ("{call}", F.when(u % 2 == 0, "get").otherwise("relay"))):
        text = F.replace(text, F.lit(key), value.cast("string"))
    return j.select(F.concat(F.lit("calls/u"), u.cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"),
                    F.col("rn").cast("int").alias("line"), text.alias("text"))


# FIXED VALUES: file templates (k, language, ext, lines) that go before a document's text.  Together they
# hold a match of every rule of the default pack; {id} is the document's id.
FILE_TEMPLATES = [
    (0, "python", "py", [
        "import pickle, yaml, hashlib", "q = 'x{id}'.format(a) + 'SELECT 1'", "subprocess.run(cmd, shell=True)", "exec(code{id})",
        "env = Env(autoescape = False)", "data = pickle.load(f)", "cfg = yaml.load(s)", "h = hashlib.sha1(b)",
        "r = random.random()", "t = xml.etree.ElementTree.parse(p)", "requests.get(url)", "f = open(base + name)",
        "app.run(debug=True)", "logger.debug('password {id}')"]),
    (1, "javascript", "js", [
        "const fs = require('fs');", "const cb{id} = (e) => {", "};", "const q = 'SELECT ' + id{id};", "eval(x);", "document.write(y);", "el.innerHTML = z;", "const api_key = 'abcdefghij{id}klmnopqrst';",
        "const jwt_secret = 's{id}';", "console.log(password);", "crypto.createHash('md5')", "Math.random()", "axios.get(url)",
        "res.setHeader('Access-Control-Allow-Origin', '*');", "res.redirect(req.query.to);"]),
    (2, "typescript", "ts", ["const fn = async (a: number) => a;", "JWT_SECRET = 'v{id}'", "DEBUG = true", "export interface I{id} extends B {", "}"]),
    (3, "go", "go", ["type R{id} interface {", "}", "password := \"p\"", "password = 'g{id}'", "func f{id}(a string) {", "}"]),
    (4, "java", "java", ["public interface J{id} extends K, L {", "}", "xml.etree.ElementTree.parse", "String api-key = 'abcdefghijklmnop{id}';"]),
    (5, "php", "php", ["class P{id} implements A, B {", "}", "$password = 'h{id}';", "eval($x);"]),
    (6, "rust", "rs", ["unsafe {", "  let password = \"r{id}\";", "  system(x); exec(y); eval(z);", "}"]),
]


def corpus_files(documents: DataFrame) -> DataFrame:
    """source_files(path, language, content): a template chosen by doc_id, then the document's text.

    Built inside the row: whole files of every language, with no grouping.
    """
    k = F.pmod(F.col("doc_id"), F.lit(len(FILE_TEMPLATES)))

    def pick(values):
        out = None
        for t, v in enumerate(values):
            out = F.when(k == t, F.lit(v)) if out is None else out.when(k == t, F.lit(v))
        return out
    head = F.replace(pick(["\n".join(t[3]) + "\n" for t in FILE_TEMPLATES]), F.lit("{id}"), F.col("doc_id").cast("string"))
    return documents.select(
        F.concat(F.lit("doc/d"), F.col("doc_id").cast("string"), F.lit("."), pick([t[2] for t in FILE_TEMPLATES])).alias("path"),
        pick([t[1] for t in FILE_TEMPLATES]).alias("language"), F.concat(head, F.coalesce("text", F.lit(""))).alias("content"))
