"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app_name: str = "loadweave", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings a meter job wants.

    Shuffle partitions are left to the caller: on a cluster AQE coalesces a
    generous setting, in local tests a small one is passed in.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the wall clock to UTC; all readings are stored as naive local time."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, used for checkpoints and stream state.

    The cluster names it in ``spark.checkpoint.dir``. Only on one machine (a
    local master, as in tests) a temporary folder is made where nothing is set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="loadweave-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint()`` at the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
