"""Append-only run ledger ``(run_id, step, status, ts, detail)``.

Each step appends one small JSON-lines file through the Hadoop FileSystem API
(any shared file system the cluster uses), so logging a step costs no Spark
job. Readers load the folder with ``spark.read.json``. A run id never repeats;
should a step of a run be written twice, readers keep its last row.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fs import exists, hadoop_path
from .literal import literal_table

SCHEMA = "run_id string, step string, status string, ts timestamp, detail string"


def append(spark: SparkSession, path: str, run_id: str, step: str, status: str, detail: str = "") -> None:
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    line = json.dumps({"run_id": run_id, "step": step, "status": status,
                       "ts": now.isoformat(timespec="microseconds"), "detail": detail}, ensure_ascii=False)
    name = f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}.json"
    p, fs = hadoop_path(spark, f"{path.rstrip('/')}/{name}")
    out = fs.create(p, False)
    try:
        out.write(bytearray((line + "\n").encode("utf-8")))
    finally:
        out.close()


def read(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return literal_table(spark, [], SCHEMA)
    df = spark.read.schema(SCHEMA).json(path)
    w = Window.partitionBy("run_id", "step").orderBy(F.col("ts").desc())
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
