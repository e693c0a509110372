"""Session defaults, the shared scratch folder and staging."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_scratch: tempfile.TemporaryDirectory | None = None
_staged: list[str] = []
_tables: list[str] = []


def get_spark(app_name: str = "claimlens", **conf: str) -> SparkSession:
    """Active session, or a new one. Cluster sizing stays with the submitter's configuration."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, taken from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a private temporary folder, which goes when Python ends:
    executors of a cluster cannot see the driver's disk.
    """
    global _local_scratch
    base = spark.conf.get(_CHECKPOINT_KEY, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder all executors can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.TemporaryDirectory(prefix="claimlens-")
    return _local_scratch.name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``drop_staged`` deletes what was written there."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def scratch_table(name: str) -> str:
    """A table of the session's catalog that ``drop_staged`` takes out of it; its files belong under a ``scratch_path``."""
    _tables.append(name)
    return name


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return a scan of it.

    Used where a result is read more than once: the lineage is cut by a table that survives executor
    loss, later reads prune columns, and Catalyst plans joins with its true size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(staged: DataFrame) -> None:
    """Delete one table that ``stage`` returned, before ``drop_staged`` does; nothing may read it any more."""
    folders = {file.rsplit("/", 1)[0] for file in staged.inputFiles()}
    conf = staged.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for path in [p for p in _staged if any(f.endswith(p.split(":", 1)[-1].rstrip("/")) for f in folders)]:
        target = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        _staged.remove(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete what this process wrote to the shared folder; returns the number of paths.

    To be called when no DataFrame that reads one of them is used any more.
    """
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    dropped = 0
    while _staged:
        target = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        dropped += target.getFileSystem(conf).delete(target, True)
    return dropped
