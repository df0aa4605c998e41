"""Spark session settings used by the jobs.

On a cluster the session is created by the platform; `configure` only sets
SQL options that the jobs rely on (UTC, AQE, skew handling) and never touches
resources.  `local_session` is for tests and the local bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SQL_CONF.items():
        spark.conf.set(k, v)
    return spark


#: Shuffled bytes that one task of the marketplace jobs reads, and partitions that its rows are dealt over to keep that.
TASK_BYTES, TASK_PARTITIONS = 8 << 20, 400


def bound_tasks(spark: SparkSession) -> None:
    """Let adaptive execution join shuffle partitions up to ``TASK_BYTES`` only: sorts and hash maps of a task
    then keep their size while the input grows.  Smaller settings of the session stay."""
    size, partitions = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > TASK_BYTES:
        spark.conf.set(size, str(TASK_BYTES))
    given = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASK_PARTITIONS)
    spark.conf.set(partitions, str(given))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mercato")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SQL_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it as
    is.  Only a local-mode session without one (tests) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    scratch = tempfile.mkdtemp(prefix="mercato-ckpt-", dir=os.environ.get("MERCATO_SCRATCH", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


#: Whether a query takes away its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet.  Only the rows stay on disk: the shuffle files of the write go when it ends, not when
    the driver's memory is next collected, so that a job of several stored tables holds those of one at a time."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read again:
    several jobs then see the same rows and none makes them anew."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    store(df, path)
    return spark.read.schema(df.schema).parquet(path)


def run_concurrently(spark: SparkSession, actions, max_workers: int = 8) -> list:
    """Run independent Spark actions as concurrent jobs (thread pool), keeping
    the caller's job group and description on every job."""
    from concurrent.futures import ThreadPoolExecutor

    sc = spark.sparkContext
    props = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description",
                                                 "spark.scheduler.pool")}

    def call(action):
        for k, v in props.items():
            if v is not None:
                sc.setLocalProperty(k, v)
        return action()

    actions = list(actions)
    if max_workers <= 1 or len(actions) <= 1:
        return [a() for a in actions]
    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        return list(pool.map(call, actions))
