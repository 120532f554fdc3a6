"""Session construction and the shared scratch folder.

On a cluster the session comes from ``spark-submit``; this module only fills in
SQL settings that the submitted configuration leaves unset. The one folder every
job may write scratch tables to is the cluster's ``spark.checkpoint.dir`` (a
shared file system); a local fallback is created only when a local session names
none, as in tests, and only once something is staged. ``clean_scratch`` deletes
what the application staged.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

LOCAL_DRIVER_MEMORY = "8g"

# Runtime SQL settings, applied where the submitted configuration has none.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Fixed at start-up, so set only for sessions that this module starts itself.
LOCAL_CONF = {
    "spark.driver.memory": LOCAL_DRIVER_MEMORY,  # local mode: the driver JVM is the only executor
    "spark.ui.enabled": "false",
    # Finished jobs' shuffle files and broadcasts are released when the driver's
    # references to them are garbage-collected; with a large driver heap that can
    # take long and slows later jobs in the same session (measured: ~40 % after a
    # full ETL, gone after a GC). A periodic GC every 5 minutes bounds that.
    "spark.cleaner.periodicGC.interval": "5min",
}


def build_session(
    master: str | None = None,
    app_name: str = "varloom",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with adaptive execution on, unless its configuration says otherwise.

    ``master`` and ``shuffle_partitions`` are for local runs; under
    ``spark-submit`` leave them ``None`` so the cluster configuration wins.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            for key, value in LOCAL_CONF.items():
                builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    submitted = spark.sparkContext.getConf()
    for key, value in DEFAULT_CONF.items():
        if not submitted.contains(key) and key not in (extra_conf or {}):
            spark.conf.set(key, value)
    return spark


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Put this library on the Python workers' path, wherever the driver found it."""
    environment = spark.sparkContext.environment
    path = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in path:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, path)])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder (``spark.checkpoint.dir``).

    Only a local-mode session without one gets a fresh local folder (tests);
    on a cluster a machine-local folder would not be shared, so it is an error.
    A ``file:`` folder on a cluster works only where it is a shared mount, which
    cannot be seen from here: it is taken as given, with a warning.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    local = sc.master.startswith("local")
    if not configured:
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="varloom-ckpt-")
    elif configured.startswith("file:") and not local:
        warnings.warn(f"{configured} must be a mount that all executors share", stacklevel=2)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    """The folder under the checkpoint folder that holds this application's scratch tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/varloom-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path for a scratch table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table on whatever file system it is on; a missing one is fine."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application. Frames that read one are unusable after."""
    if spark.sparkContext.getCheckpointDir():
        delete_path(spark, scratch_root(spark))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Used where a frame feeds several branches of one plan (or many jobs): the
    upstream runs once, and a lost executor recomputes from this table instead
    of from the original inputs.
    """
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
