"""Spark session and shared-folder helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "boardlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; extra confs win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; on any other than a local
    master a missing name is an error, as executors would each write to a disk of
    their own. A local session (a laptop, a test) gets one folder per application.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="boardlens-")
    return _LOCAL_DIRS[app]


_WORKSPACES: list[str] = []


def top_folder(spark: SparkSession) -> str:
    """The open workspace, or the shared folder."""
    return _WORKSPACES[-1] if _WORKSPACES else shared_dir(spark).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder (or the open workspace) that no other run uses."""
    return f"{top_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def workspace(spark: SparkSession, label: str):
    """While open, intermediates go to a folder of its own, which is removed at the end.

    DataFrames that read from it must have been written elsewhere by then.
    """
    folder = new_folder(spark, label)
    _WORKSPACES.append(folder)
    try:
        yield folder
    finally:
        _WORKSPACES.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(df, label: str):
    """Write an intermediate that several branches read, and read it back.

    One computation feeds all branches, lineage is cut, and the copy lies in the
    shared folder, so a lost executor costs no recomputation of what went before.
    Shuffle files that nothing refers to any more are given up, which Spark does
    only when the driver's heap is collected.
    """
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(folder)
