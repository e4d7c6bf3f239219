"""Session settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Applied to any session, the caller's own included: adaptive execution is what
# splits skewed join partitions and decides joins by measured size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A union must not pass for partitioned by key: adaptive execution may still move
    # one of its sides, and then a repartition before a file sink would be dropped.
    "spark.sql.unionOutputPartitioning": "false",
    # Folders of many small files are listed by this many tasks, not by one for each folder.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "96",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `master` only for local work."""
    builder = SparkSession.builder.appName("gridspark")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a scratch one only in local mode with none set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()
