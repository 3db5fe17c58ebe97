"""SparkSession construction and cluster-level settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins at runtime: a join
# side whose *measured* shuffle output is under the adaptive broadcast
# threshold becomes a broadcast hash join, otherwise it stays a
# sort-merge join, and skewed partitions of a sort-merge join are split.
DEFAULT_CONF = {
    # local mode: the driver JVM is the only executor (ignored when the
    # session already runs or a cluster manager sizes the executors)
    "spark.driver.memory": "16g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # a join on (post_id, x) may reuse a partitioning on post_id alone
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def get_session(master: str | None = None, app: str = "moodgrid",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the engine's defaults.

    ``master`` is only set when given: on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point ``SparkContext`` at the shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir`` (the cluster names a
    shared, fault-tolerant location there).  Only when it is unset *and*
    Spark runs in local mode (tests) a fresh scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative jobs need a "
                "shared checkpoint folder on the cluster")
        path = tempfile.mkdtemp(prefix="moodgrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if path.startswith("/"):
        os.makedirs(path, exist_ok=True)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``moodgrid`` importable in Python workers (the pandas kernels
    of the distance operators): zip the package once per context and add
    it with ``addPyFile`` — the same as ``spark-submit --py-files``."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import shutil
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = tempfile.mkdtemp(prefix="moodgrid-pyfiles-")
    z = shutil.make_archive(os.path.join(out, "moodgrid"), "zip", root_dir=root, base_dir="moodgrid")
    sc.addPyFile(z)
    _SHIPPED.add(key)
