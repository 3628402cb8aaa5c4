"""SparkSession settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every job wants: UTC clock (dates are UTC partition keys), AQE with
# partition coalescing and skew-join splitting, and Arrow for pandas hand-off.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # JSON objects may repeat a key; the last one counts, as in the tracker's parser
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """Session for tests and local runs. On a cluster, pass the cluster's own session."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Set the session-level settings above on a session someone else built."""
    for k, v in DEFAULT_CONF.items():
        if k == "spark.ui.enabled":
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting is used as is.  Only a local master, where driver and executors share one disk, may leave it
    unset; then a folder under /tmp is chosen.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = os.environ.get("TIDEMARK_CHECKPOINT_DIR", "/tmp/tidemark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, *parts: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])
