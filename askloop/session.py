"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_local_roots: dict[str, str] = {}


def get_session(app: str = "askloop", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC time. On a cluster leave ``master`` unset.

    Further settings are given with ``__`` for the dot, such as ``spark__sql__shuffle__partitions="20000"``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local-mode session without the setting gets a folder of its own, which goes with the process; a cluster
    without it is an error, because a driver-local path would be lost with the machine.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = root = tempfile.mkdtemp(prefix="askloop-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return _local_roots[context.applicationId]


def materialize(df: DataFrame, name: str, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared folder, or to ``path`` (replaced if there), and read it back.

    Used where a result feeds several jobs: the lineage ends in durable files, so a lost executor costs no
    recomputation, and later reads still prune columns and push filters. Columns of ``partition_by`` become folders.
    """
    spark, by = df.sparkSession, partition_by or []
    mode = "error" if path is None else "overwrite"
    path = path or f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode(mode).partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
