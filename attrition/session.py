"""Session creation and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every session of the engine wants; a cluster launcher may override.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Deep projection stacks of CASE expressions made constraint inference
    # take a minute of planning per join; filters are pushed explicitly.
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Runtime SQL settings the engine relies on; applied to any session a
# query receives (they are session-level and safe to set at run time).
ENGINE_SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}


def apply_engine_conf(spark: SparkSession) -> SparkSession:
    for k, v in ENGINE_SQL_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "attrition", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults.

    ``master``/``shuffle_partitions`` are only for local runs and tests; on a
    cluster leave them unset so the launcher's settings win.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``; only a local master without one gets a new folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="attrition-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables
    (never a machine-local temp folder, so it survives executor loss)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def shared_folder(spark: SparkSession, name: str) -> str | None:
    """A sub-folder of the folder that ``spark.checkpoint.dir`` names, the same
    one for all applications; None where the setting is not made."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return f"{configured.rstrip('/')}/{name}" if configured else None


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as parquet under the shared checkpoint
    folder and reading it back.  Like a reliable checkpoint it survives
    executor loss; unlike ``Dataset.checkpoint`` the new plan's size
    statistics come from the written files, so iterated steps do not
    compound join-size estimates (Catalyst multiplies child sizes for
    joins, which grows without bound across chained checkpoints)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def python_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where the driver has it
    (same place on every machine; else send it with ``--py-files``), one thread
    of linear algebra for each task."""
    env = spark.sparkContext.environment
    env.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        env.setdefault(name, "1")
    return spark


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """For jobs run inside, Arrow batches end by their number of rows only.  By
    default Spark adds up all columns' buffers after every row to end a batch by
    bytes as well, which costs short rows with nested columns more than the rest."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(2 ** 31 - 1))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def cluster_conf(input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings sized for a cluster run over ``input_bytes`` of parquet:
    scan splits and the initial shuffle width aim at ~256 MB partitions
    (AQE then coalesces small ones and splits skewed ones), so every task
    fits executor memory at any scale factor."""
    parts = max(200, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }
