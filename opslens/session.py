"""Session helpers.

Library code never creates its own session; it receives one. These helpers
exist for tests, the bench and the CLI-style entry points.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "opslens", driver_memory: str = "8g") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Timestamps are UTC wall-clock values throughout (TIMESTAMP_NTZ inputs,
    hour/day buckets, formatted periods), so the session time zone is UTC."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster `spark.checkpoint.dir` names a shared folder and is used as
    is; without it this raises, since executors would write to their own
    disks. Only a local master (one machine, as in tests) gets a scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="opslens-ckpt-")
    known = spark.sparkContext.getCheckpointDir() or ""
    if current.rpartition(":")[2].strip("/") not in known:
        spark.sparkContext.setCheckpointDir(current)
    return current


def materialize(df, tag: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    return the re-read table: later uses read the files instead of
    recomputing the plan, and the lineage is cut (survives lost executors)."""
    import uuid
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{tag}-{uuid.uuid4().hex[:12]}")
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)
