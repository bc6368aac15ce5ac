"""Tables cut to shared storage.

Iterative operators end the lineage of each round at Parquet files in the
folder that all executors share, so a lost executor costs a task, not the
rounds before, and plans do not grow with the number of rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where it is unset, a local-mode session gets a temporary folder (driver and
    executors are one process there); any other session must set it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _LOCAL_ROOTS[app]


def _hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/weftline-{label}-{uuid.uuid4().hex}"
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


def cut(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``.path`` names it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table made by :func:`cut` or :func:`bucketed` that nothing reads any more."""
    if "table" in vars(df):
        df.sparkSession.sql(f"DROP TABLE {vars(df)['table']}")
    drop_path(df.sparkSession, df.path)


def bucketed(df: DataFrame, by: str, label: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``by``, sorted by it within:
    joins on it do not move these rows again, and a filter on it reads its bucket
    alone.  ``.path`` names it, ``.table`` its entry in the session's catalogue."""
    spark = df.sparkSession
    path = new_path(spark, label)
    name, buckets = f"weftline_{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.path, out.table = path, name
    return out
