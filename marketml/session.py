"""Session-level helpers: the shared checkpoint folder and materialisation.

The library never builds a SparkSession; callers pass theirs in.  Everything
here reads settings from that session.
"""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Order: the SparkContext's checkpoint dir, then ``spark.checkpoint.dir``.
    Where neither is set, a folder of the warehouse, which executors and
    driver share as well.  The rule is the same for every master.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


# Per-thread stacks, so a cleanup scope only sees writes made by its own
# thread (queries may run from several driver threads).
_LOCAL = threading.local()


def _trackers() -> list[list[str]]:
    if not hasattr(_LOCAL, "stack"):
        _LOCAL.stack = []
    return _LOCAL.stack


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never-reused path under the shared checkpoint folder, owned by
    the scratch scopes that are open in this thread."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/marketml/{label}-{uuid.uuid4().hex}"
    for t in _trackers():
        t.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage (a lost executor re-reads files instead of recomputing
    upstream shuffles) and freezes nondeterministic columns such as
    ``monotonically_increasing_id`` so several later passes see one value.
    Parquet keeps the copy columnar, so later passes prune columns.
    """
    return df.sparkSession.read.parquet(write_scratch(df, label))


def write_scratch(df: DataFrame, label: str) -> str:
    """Write ``df`` as Parquet to a fresh path in the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Own every scratch path named inside the block (market tables, quantile
    tables, CSV copies, archives) and delete them on exit.  Results are lazy, so
    read or write them before the block ends."""
    paths: list[str] = []
    _trackers().append(paths)
    try:
        yield paths
    finally:
        # By identity: two scopes that hold the same paths are equal lists.
        _LOCAL.stack = [t for t in _trackers() if t is not paths]
        delete_paths(spark, paths)


def delete_paths(spark: SparkSession, paths) -> None:
    """Recursively delete paths through the Hadoop FileSystem API (works for
    any cluster file system, not only the local one)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)
