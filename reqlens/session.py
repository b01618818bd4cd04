"""Session helpers.

The library never creates its own cluster configuration: it reads what the
session says.  ``get_spark`` is a convenience for tests, benches and scripts.
``shared_dir`` hands out folders under ``spark.checkpoint.dir`` — the shared
folder a cluster names for checkpoints.  A session without one gets a local
folder only if its master is local (tests); on a cluster that is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(master: str | None = None, app: str = "reqlens",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Get (or create) a session with settings the library relies on.

    ``spark.sql.session.timeZone=UTC`` keeps bucket boundaries and parsed
    instants independent of the machine; AQE re-plans joins and coalesces
    shuffle partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # sketches of up to so many groups stay in a task's hash map before it sorts instead (128 by default)
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` as the cluster
    names it (or the context's checkpoint dir); a local folder is created only
    when neither is set and the master is local, as in tests."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get(CHECKPOINT_CONF, None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current.removeprefix("file:")
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError(f"{CHECKPOINT_CONF} is not set: executors need a folder that all of them share")
    local = tempfile.mkdtemp(prefix="reqlens-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().removeprefix("file:")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (unique per call)."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
    return path
