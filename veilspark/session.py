"""Spark session helpers.

On a cluster the session already exists and carries its own settings; these
helpers only fill in what is missing, so a cluster's ``spark.checkpoint.dir``
or shuffle sizing is never overridden.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins and coalesces shuffle
# partitions at run time; skew-join splitting protects against a hot doc_id or
# model key holding a large share of the rows.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "veilspark", extra: dict | None = None,
                local_driver_memory: str = "16g") -> SparkSession:
    """Return the active session, or build a local one (tests, bench).

    In local mode the driver JVM is the only executor, so its heap is the
    only memory knob; Spark's 1g default is too small for shuffles of the
    token tables. Cluster sessions keep whatever the cluster configured.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = local_driver_memory
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only when unset.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that value is
    always used as is. Only a bare local session (tests) gets a scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="veilspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


_folders: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path (not created) under the shared checkpoint folder; removed when this driver process ends."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/veilspark-{uuid.uuid4().hex}"
    _folders.append((spark, base))
    return f"{base}/{name}"


def scratch_folders() -> list[str]:
    """The scratch folders that this driver process has made and not removed."""
    return [base for _, base in _folders]


def remove_scratch(bases: list[str]) -> None:
    """Remove scratch folders that nothing reads any more."""
    for spark, base in [f for f in _folders if f[1] in bases]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _folders.remove((spark, base))


@atexit.register
def _remove_folders() -> None:
    for _, base in list(_folders):
        try:
            remove_scratch([base])
        except Exception:  # the session has ended already; whoever owns the shared folder cleans it
            return
