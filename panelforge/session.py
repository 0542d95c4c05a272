"""Session helpers: runtime SQL settings and a shared checkpoint folder.

Nothing here starts a server: the UI stays off and the session is a plain
``local[N]`` in tests. On a cluster the caller owns the session; we only set
runtime SQL options that are safe to change per session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime settings every operator in this package assumes.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings (idempotent, no restart needed)."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "panelforge") -> SparkSession:
    """A local session for tests and the bench (UI off, no ports beyond Spark's own)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is unset in local mode (tests) do we pick a scratch folder
    and register it, so that ``DataFrame.checkpoint()`` has somewhere to write.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="panelforge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scale_conf(input_bytes: int, cores: int, partition_bytes: int = 128 << 20) -> dict:
    """Suggested session settings for a run reading ``input_bytes`` on ``cores``.

    * Initial shuffle partitions: enough for ~``partition_bytes`` per
      partition if a stage shuffled its whole input, and at least 3 waves of
      tasks; AQE coalesces the small ones afterwards, so over-sizing is cheap.
    * File splits of 256 MB keep scan tasks long enough to amortise overhead.
    * AQE skew join splits a partition that is 5× the median and over 256 MB,
      so a key holding a third of the rows is spread over many tasks.
    Apply with ``for k, v in scale_conf(...).items(): spark.conf.set(k, v)``.
    """
    shuffle = max(3 * cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
    }
