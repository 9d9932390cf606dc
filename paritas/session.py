"""SparkSession construction with settings the operators rely on.

Only settings that are unset are filled in, so a cluster's own configuration
(shuffle partitions, checkpoint folder, memory) always wins.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings every job here assumes. AQE gives runtime coalescing and skew-join
# splitting; UTC keeps timestamps comparable with the SQL oracle.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Remove checkpoint files once their data is no longer referenced
    # (the ordered scans checkpoint into the shared folder).
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "paritas",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session. ``master`` is only applied for local runs;
    ``shuffle_partitions`` and ``extra`` are explicit and always applied."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    # What the launch already configures (spark-defaults, --conf) wins.
    launched = SparkConf()
    for k, v in _DEFAULTS.items():
        if not launched.contains(k):
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a run in one process (tests) without one gets a private folder; on a
    cluster a missing setting is an error, since a machine-local folder would
    not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(intermediate tables and checkpoints go there)")
        configured = tempfile.mkdtemp(prefix="paritas-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, name) if "://" not in root else root.rstrip("/") + "/" + name
