"""Sets of tables that appear as a whole: report sheets, backups.

A set is written below a folder of its own name and a token; then one row is added to a manifest, and that makes it visible. What
has no row, as its write failed or hasn't ended, is never read, nor taken for the newest. Writing a name again
replaces it in one step. Dropping adds a row as well, before files go. The manifest has a row for each commit.

Edge cases: empty tables are sets like others; a folder without a manifest has no sets; a name that isn't there is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "name string, number bigint, token string, kind string, dropped boolean, tables map<string,bigint>"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    where = f"{path.rstrip('/')}/manifest"
    return spark.read.schema(MANIFEST).json(where) if _exists(spark, where) else spark.createDataFrame([], MANIFEST)


def _added(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/manifest")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """name, number, token, kind and tables (rows of each) of all sets: of each name the last that was written, if it wasn't dropped since."""
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("number"), F.desc("token")))
    return _manifest(spark, path).withColumn("_n", last).where("_n = 1 AND NOT dropped").drop("_n", "dropped")


def _next(spark: SparkSession, path: str) -> int:
    return (_manifest(spark, path).agg(F.max("number")).first()[0] or 0) + 1


def commit(tables: dict[str, DataFrame], path: str, name: str, kind: str = "parquet", **options: str) -> str:
    """Writes a set; its folder. Nothing is visible before all tables are whole."""
    spark, token = next(iter(tables.values())).sparkSession, uuid.uuid4().hex[:12]
    folder, rows = f"{path.rstrip('/')}/{name}/{token}", {}
    for table, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format(kind).options(**options).save(f"{folder}/{table}")
        rows[table] = seen.get["n"]
    _added(spark, path, [(name, _next(spark, path), token, kind, False, rows)])
    return folder


def read_committed(spark: SparkSession, path: str, table: str, name: str | None = None, schema: str | None = None, **options: str) -> DataFrame:
    """A table of the set of this name, or of the one whose name is the greatest (stamps and days sort by time)."""
    sets = committed(spark, path)
    found = (sets if name is None else sets.where(F.col("name") == name)).orderBy(F.desc("name")).first()
    if found is None:
        raise ValueError(f"no whole set {name or ''} below {path}")
    reader = spark.read.format(found["kind"]).options(**options)
    return (reader.schema(schema) if schema else reader).load(f"{path.rstrip('/')}/{found['name']}/{found['token']}/{table}")


def drop(spark: SparkSession, path: str, names: list[str]) -> None:
    """Sets of these names go: first from the manifest, then their files and what unfinished writes of the same names left."""
    if not names:
        return
    number = _next(spark, path)
    _added(spark, path, [(n, number, "", "", True, {}) for n in names])
    for n in names:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{n}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession, path: str) -> int:
    """Deletes folders of writes that were replaced or never ended; how many. Not to be run beside a write."""
    live = {(r["name"], r["token"]) for r in committed(spark, path).select("name", "token").collect()}  # as many as sets
    jvm, root = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    system, gone = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    for outer in system.listStatus(root):
        name = outer.getPath().getName()
        if name == "manifest" or not outer.isDirectory():
            continue
        for inner in system.listStatus(outer.getPath()):
            if (name, inner.getPath().getName()) not in live:
                gone += system.delete(jvm.org.apache.hadoop.fs.Path(inner.getPath().toString()), True)
    return gone


# ------------------------------------------------------- reports and backups
def write_report(sheets: dict[str, DataFrame], path: str, day: str) -> str:
    """A day's report of several sheets, as CSV; a re-run replaces the day's."""
    return commit(sheets, path, day, "csv", header="true")


def read_sheet(spark: SparkSession, path: str, sheet: str, day: str | None = None, schema: str | None = None) -> DataFrame:
    """A sheet of a day's report, or of the last one's."""
    return read_committed(spark, path, sheet, day, schema, header="true")


def backup(df: DataFrame, path: str, stamp: str) -> str:
    """A snapshot under the stamp."""
    return commit({"data": df}, path, stamp, "parquet", compression="gzip")


def restored(spark: SparkSession, path: str, stamp: str | None = None) -> DataFrame:
    """A whole snapshot; the newest if no stamp is named."""
    return read_committed(spark, path, "data", stamp)


def backups(spark: SparkSession, path: str) -> DataFrame:
    """(stamp, n_rows, size_mb, modified) of whole snapshots, newest first."""
    sets = committed(spark, path).select(F.col("name").alias("stamp"), "token", F.col("tables")["data"].alias("n_rows"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    place = r"/([^/]+)/([^/]+)/data/[^/]+$"
    sizes = files.groupBy(F.regexp_extract("path", place, 1).alias("stamp"), F.regexp_extract("path", place, 2).alias("token")).agg(F.sum("length").alias("_bytes"), F.max("modificationTime").alias("modified"))
    out = sets.join(sizes, ["stamp", "token"], "left")
    return out.select("stamp", "n_rows", F.round(F.coalesce("_bytes", F.lit(0)) / 1048576, 2).alias("size_mb"), "modified").orderBy(F.desc("stamp"))


def expire_backups(spark: SparkSession, path: str, before: str) -> list[str]:
    """Snapshots with stamps below this one go, but for the newest of all; their stamps."""
    stamps = [r["name"] for r in committed(spark, path).select("name").orderBy("name").collect()]  # as many as snapshots
    old = [s for s in stamps[:-1] if s < before]
    drop(spark, path, old)
    return old
