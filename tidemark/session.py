"""A local session with the settings the library expects (tests and bench only)."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that also belong on a cluster: UTC, adaptive execution with skew-join splitting.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str | int = 8, partitions: int = 8) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.maxFields", "200")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:  # one machine: any folder is shared
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark
