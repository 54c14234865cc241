"""Structure and call graph of a changing source tree, kept up to date batch by batch (X4, the ``foreachBatch`` part).

A ``FactStore`` is a folder of Parquet tables cut into buckets:

* by path:  files, functions, classes, owned (the name buckets that a file's names lie in)
* by name:  defs (last definition per name and file), calls (with their caller and, where resolved, their callee)

A batch brings whole files, new or changed, and paths that are gone.  Facts of
its files are computed as in a batch run (class context, end lines and callers
need whole files, never other files).  Then only the buckets that hold a
touched file or name are rewritten, as a new version; every other bucket stays
where it is.  Inside them, a call is resolved again only if its own file
changed or its name's last definition in the tree did; all others keep their
callee.  One manifest file per batch names every bucket's version: a batch is
there when its manifest is, a replayed batch starts from the manifest before it
and overwrites what it left, so each batch counts once.

Names resolve to the last definition of the whole tree, as call_graph(strict_order=False).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import catalog as C
from vigil.operators import facts, graph
from vigil.operators.lines import annotate, calls_table, explode_lines
from vigil.session import materialized
from vigil.sources.files import read_source_files
from vigil.streaming.scan import source_stream

#: table -> (columns whose hash is its bucket, schema)
TABLES = {
    "files": (["path"], "path string, language string, modified timestamp"),
    "functions": (["path"], "fn_id string, path string, language string, name string, line int, end_line int, return_type string, "
                            "is_async boolean, is_exported boolean, is_method boolean, class_name string, method_of_line int, "
                            "decorators array<string>, parameters array<struct<name:string,type:string,default_value:string,"
                            "is_optional:boolean,is_variadic:boolean>>"),
    "classes": (["path"], "class_id string, path string, language string, kind string, name string, line int, end_line int, "
                          "parent_class string, interfaces array<string>, decorators array<string>"),
    "owned": (["path"], "path string, name_bucket int"),
    "defs": (["language", "name"], "language string, name string, path string, to_id string"),
    "calls": (["language", "name"], "language string, name string, path string, line int, call_ord int, from_id string, from_name string, to_id string"),
}
MANIFEST = "table string, bucket int, version long"


class FactStore:
    """root: a folder that the driver and all executors share; buckets is fixed when the store is made."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ------------------------------------------------------------- reading --
    def functions(self) -> DataFrame:
        return self.table("functions")

    def classes(self) -> DataFrame:
        return self.table("classes")

    def nodes(self) -> DataFrame:
        return graph.call_nodes(self.functions())

    def edges(self) -> DataFrame:
        """The columns of graph.call_edges."""
        c = self.table("calls").filter("to_id IS NOT NULL")
        return c.select("from_id", "from_name", "to_id", F.col("name").alias("to_name"), "path", "language", "line", "call_ord")

    def table(self, name: str) -> DataFrame:
        return self._read(name, self._manifest(None))

    def _bucket(self, columns: list[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _manifest(self, before: int | None) -> dict[tuple[str, int], int]:
        """(table, bucket) -> version after the last batch, or the last one below ``before``: at most one row per bucket."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return {}
        rows = self.spark.read.schema(MANIFEST + ", batch long").parquet(f"{self.root}/manifest")
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        last = rows.agg(F.max("batch")).first()[0]
        return {(r.table, r.bucket): r.version for r in rows.filter(F.col("batch") == last).collect()} if last is not None else {}

    def _read(self, name: str, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = TABLES[name][1]
        paths = [f"{self.root}/{name}/version={v}/bucket={b}" for (t, b), v in sorted(manifest.items())
                 if t == name and (buckets is None or b in buckets)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # ------------------------------------------------------------- writing --
    def _write(self, name: str, rows: DataFrame, touched: set[int], batch: int, manifest: dict) -> None:
        """The touched buckets as a new version.  Adaptive execution cuts a bucket of many rows into several files."""
        keys, schema = TABLES[name]
        path = f"{self.root}/{name}/version={batch}"
        columns = [c.split(" ")[0].strip("`") for c in self.spark.createDataFrame([], schema).columns]
        rows = rows.select(*columns, self._bucket(keys).alias("bucket")).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(path)
        filled = self.spark.read.schema(schema + ", bucket int").parquet(path).select("bucket").distinct()
        for b in touched:
            manifest.pop((name, b), None)
        manifest.update({(name, r.bucket): batch for r in filled.collect()})

    def apply(self, batch: int, files: DataFrame, deleted: DataFrame | None = None) -> None:
        """One batch: files(path, language, content[, modified]) replace what was known of their paths, deleted(path) go.

        Batches have rising numbers; a number that was applied before is applied anew to the state before it.
        """
        manifest = self._manifest(batch)
        if "modified" not in files.columns:
            files = files.withColumn("modified", F.lit(None).cast("timestamp"))
        new_files = files.select("path", "language", "modified")
        lines = materialized(facts.fact_lines(annotate(explode_lines(files)), with_calls=True))
        functions = materialized(facts.functions_table(lines))
        calls = graph.enclosing_function(calls_table(lines.filter(F.size("calls") > 0)), functions, "_caller").filter("_caller IS NOT NULL")
        calls = materialized(calls.select("language", "name", "path", "line", "call_ord", F.col("_caller.fn_id").alias("from_id"),
                                          F.col("_caller.name").alias("from_name")))
        defs = functions.groupBy("language", "name", "path").agg(F.max_by("fn_id", "line").alias("to_id"))
        changed = new_files.select("path")
        if deleted is not None:
            changed = changed.unionByName(deleted.select("path"))
        changed = materialized(changed.distinct())

        paths = {r[0] for r in changed.select(self._bucket(["path"])).distinct().collect()}  # at most one row per bucket, here and below
        name_bucket = self._bucket(["language", "name"]).alias("name_bucket")
        owned = defs.select("path", name_bucket).unionByName(calls.select("path", name_bucket)).distinct()
        was_owned = self._read("owned", manifest, paths).join(changed, "path", "left_semi")
        names = {r[0] for r in owned.select("name_bucket").unionByName(was_owned.select("name_bucket")).distinct().collect()}

        fresh = {"files": new_files, "functions": functions, "classes": facts.classes_table(lines), "owned": owned}
        before = {t: self._read(t, manifest, paths) for t in fresh}
        for t, rows in fresh.items():
            self._write(t, before[t].join(changed, "path", "left_anti").unionByName(rows), paths, batch, manifest)

        old_defs, old_calls = self._read("defs", manifest, names), self._read("calls", manifest, names)
        new_defs = materialized(old_defs.join(changed, "path", "left_anti").unionByName(defs))

        def last(d, out):
            return d.groupBy("language", "name").agg(F.max_by("to_id", "path").alias(out))
        both = last(old_defs, "was").join(last(new_defs, "now"), ["language", "name"], "full")
        both = materialized(both.withColumn("moved", ~F.col("was").eqNullSafe(F.col("now"))))
        kept = old_calls.join(changed, "path", "left_anti").withColumn("asked", F.lit(False))
        all_calls = kept.unionByName(calls.withColumn("asked", F.lit(True)), allowMissingColumns=True).join(both, ["language", "name"], "left")
        again = F.col("asked") | F.coalesce("moved", F.lit(False))
        all_calls = all_calls.withColumn("to_id", F.when(again, F.col("now")).otherwise(F.col("to_id")))
        self._write("defs", new_defs, names, batch, manifest)
        self._write("calls", all_calls, names, batch, manifest)

        rows = [(t, b, v) for (t, b), v in manifest.items()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")

    def sync(self, batch: int, root: str, arrived: DataFrame | None = None, language: str = "auto",
             exclude=tuple(C.DEFAULT_EXCLUDE_PATTERNS)) -> None:
        """One batch that brings the store to the tree's state: arrived files, changed ones (by modification time), deleted ones.

        Names and times of the tree are compared with the stored ones; only
        files not older than the newest stored one are opened, besides those
        that arrived.  ``arrived`` is null for a tree read without a stream.
        """
        known = self._read("files", self._manifest(batch))
        columns = ["path", "language", "content", "modified"]
        tree = read_source_files(self.spark, root, language, exclude)
        newest = known.agg(F.max("modified")).first()[0]
        recent = tree if newest is None or arrived is None else tree.filter(F.col("modified") >= F.lit(newest))
        same = known.select("path", "modified")
        files = recent.select(*columns).join(same, ["path", "modified"], "left_anti")
        if arrived is not None:
            files = files.join(arrived.select("path"), "path", "left_anti").unionByName(arrived.select(*columns))
        deleted = known.select("path").join(tree.select("path"), "path", "left_anti")
        self.apply(batch, files, deleted)


def start_facts(spark: SparkSession, root: str, store: FactStore, checkpoint: str, available_now: bool = True,
                max_files_per_trigger: int = 1000, exclude=tuple(C.DEFAULT_EXCLUDE_PATTERNS)):
    """A stream of new files under root into the store; every micro-batch takes changed and deleted files along.

    The file source tells of new names only, so a change or a deletion is seen
    with the next new file, or by calling ``store.sync``.
    """
    files = source_stream(spark, root, max_files_per_trigger, exclude=exclude)
    w = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch: store.sync(batch, root, materialized(df), exclude=exclude))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
