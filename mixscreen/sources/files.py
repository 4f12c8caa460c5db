"""Reading and writing result files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Folders and tables made inside each open scope().
_SCOPES: list[list[tuple[str, str]]] = []


def root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, spark.checkpoint.dir; a temporary one where none is set and Spark runs in one process, as in tests, which goes when Python ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("mixscreen.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="spark-mixscreen-", dir="/tmp")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = "file://" + own
        spark.conf.set("mixscreen.scratch.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder name below root()."""
    path = f"{root(spark)}/mixscreen-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(("path", path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes at its end, also after an error: results are read, or written elsewhere, before. Scopes may be nested, in one thread."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for kind, name in reversed(_SCOPES.pop()):
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                delete(spark, name)


def written(df: DataFrame, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts lineage and survives lost executors. options: of the Parquet writer."""
    path = scratch(df.sparkSession)
    df.write.options(compression=codec, **(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The same rows as a table in the shared folder with a file for each bucket of the key, sorted by it: joins and aggregates by the key need no exchange of it."""
    spark = df.sparkSession
    path, name = scratch(spark), f"mixscreen_{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(("table", name))
    df.repartition(buckets, key).sortWithinPartitions(key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go at its end, not when the driver happens to collect its garbage; what is read twice is written before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def observed(rows: DataFrame, seen: Observation) -> dict:
    """What was observed of rows as they were written; nothing where there are none (rows should be cheap to look into, such as a table)."""
    return {} if rows.isEmpty() else seen.get


def fingerprint(spark: SparkSession, paths: list[str]) -> dict:
    """Files, bytes and a sum of hashes of path, size and time of change of all files below the paths: listed by Spark, never opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "modificationTime")
    own = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    n, size, total = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.sum(own), F.lit(0))).first()
    return {"files": n, "bytes": int(size), "hash": str(total)}


def small_side(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows (counted, not guessed), else df itself, to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Writes the columns in order, as text with a header; null and missing columns are empty."""
    have = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*have).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All values as strings, empty ones as ""; no rows if the path doesn't exist."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    try:
        df = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return df.na.fill("")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_by_profile(df: DataFrame, path: str) -> None:
    """A folder for each archetype, so that a reader of one profile opens its files alone."""
    df.write.partitionBy("archetype").parquet(path)
