"""Path checks through the Hadoop FileSystem API (HDFS, object stores, local)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that this package wrote, if it is there; the name may be a URI with escapes."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path)) if "://" in path or path.startswith("file:") else (
        jvm.org.apache.hadoop.fs.Path(path))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    p, fs = hadoop_path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
