"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every feedlake job expects.  All of them are runtime SQL confs, so
# they can be applied to a session someone else built (the driver's, a test's).
SQL_DEFAULTS = {
    # the reference pins UTC for every job; raw text timestamps depend on it
    "spark.sql.session.timeZone": "UTC",
    # runtime re-planning: coalesce small shuffles, split skewed join partitions,
    # turn sort-merge joins into broadcast joins only once the real size is known
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    # split a skewed join partition even when that costs an extra shuffle: one
    # key may hold a third of all rows
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # runtime (measured) sizes only: broadcast a side once AQE has seen it is
    # at most 64 MB; never on an estimate
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.parquet.compression.codec": "snappy",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    for key, value in SQL_DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, app_name: str = "feedlake",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session.  On a cluster, spark-submit supplies master and sizes."""
    master = master or os.environ.get("FEEDLAKE_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.driver.memory", os.environ.get("FEEDLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``.  Only when nothing is configured and all tasks
    run in this process (local tests) do we pick a fresh folder of our own; on
    a cluster, a folder of this machine would lose the others' files."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="feedlake-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir.

    Used for data a job writes and reads back (bronze files, stream
    checkpoints, versioned state).  Each call gets a new folder so runs never
    need to delete anything."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "feedlake", *parts, uuid.uuid4().hex])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package also where only the driver's
    sys.path has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


#: keyed stream state lives in RocksDB; a batch uploads its changes, not the whole store
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_state_store(spark: SparkSession) -> None:
    for key, value in STATE_STORE.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the input folders/files, from the file system."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            total += fs.getContentSummary(path).getLength()
    return total


def size_shuffles(spark: SparkSession, paths: list[str], target_bytes: int = TARGET_PARTITION_BYTES,
                  floor: int | None = None) -> int:
    """Start with enough shuffle partitions for ~target_bytes each at the
    measured input size (AQE coalesces small ones at runtime), never fewer
    than twice the cluster's cores, and split scans and AQE partitions at the
    same size.  Returns the partition count."""
    floor = floor if floor is not None else 2 * spark.sparkContext.defaultParallelism
    n = max(floor, -(-input_bytes(spark, paths) // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    return n
