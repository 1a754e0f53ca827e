"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the jobs depend on for correctness (UTC days, ANSI errors) and for
# scale (AQE re-plans joins from runtime sizes, splits skewed partitions and
# coalesces small ones).  Partition counts are left to the caller / cluster.
_JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # A repeated key in a map keeps the last value (dict semantics).
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_session(master: str | None = None, app_name: str = "lurescope",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the job settings applied.

    ``master`` is only set when given, so on a cluster the submitter decides.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false")
    for k, v in _JOB_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_job_conf(spark)
    return spark


def apply_job_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session (e.g. the driver's)."""
    for k, v in _JOB_CONF.items():
        spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from the session (``spark.checkpoint.dir`` / the context's checkpoint
    dir).  Where nothing is configured, a local session (one machine: tests)
    gets a scratch folder; on a cluster that is an error, as a machine's own
    folder is not seen by the other machines.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # no SparkContext on the client (e.g. Spark Connect)
        sc = None
    d = sc.getCheckpointDir() if sc is not None else None
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            master = spark.conf.get("spark.master", "")
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("no shared folder: set spark.checkpoint.dir (or --work-dir) to a folder "
                                   "that the driver and all executors see")
            d = tempfile.mkdtemp(prefix="lurescope-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(d)
            d = sc.getCheckpointDir() or d
    return d


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a written table, whatever file system it is on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def file_count(spark: SparkSession, path: str) -> int:
    """Files below a folder, whatever file system it is on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getFileCount())


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete, at the end, the tables that ``materialize`` wrote inside.

    For jobs whose output is written inside the scope (a batch run, a
    micro-batch): the intermediate tables have no reader afterwards.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_path(spark, path)


def register_scratch(path: str) -> None:
    """Have the innermost ``scratch_scope``, if there is one, delete ``path`` at its end."""
    if _scopes:
        _scopes[-1].append(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder for a written table."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{_process}-{next(_counter)}"


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()
_process = f"{os.getpid()}-{uuid.uuid4().hex[:8]}"  # a restarted driver never meets its predecessor's tables


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as a Parquet table in the shared folder
    (``spark.checkpoint.dir``) and reading it back.

    Used where one derived table feeds several branches that Catalyst cannot
    share (each branch pushes its own inferred filters below the aggregate,
    so exchange reuse never matches): the table is computed once and every
    branch reads the files.  One pass (an eager ``checkpoint()`` computes its
    input twice), survives executor loss, and the planner sees the real file
    size when it picks join strategies.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    register_scratch(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
