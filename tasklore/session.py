"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Every setting here is a standard Spark option; sizes are per-partition targets, not data limits.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Sessions of a hot dag are merged inside each input partition before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Key tables too big to broadcast may still cut the big side by a runtime Bloom filter.
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


def build_session(master: str = "local[8]", app: str = "tasklore", shuffle_partitions: int = 8,
                  **extra: str) -> SparkSession:
    """A session with the recommended settings; a cluster submits its own master and partition count."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**RECOMMENDED, "spark.sql.shuffle.partitions": str(shuffle_partitions), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local master may run without that setting; a machine-local folder would not be visible to
    the executors of a cluster.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":  # local-cluster has executors of its own
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="tasklore-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
