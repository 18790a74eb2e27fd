"""Session settings and the shared folder used for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording a call site per expression costs more than planning a small query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "paragem", **extra: str) -> SparkSession:
    """Return a session with the settings the operators are tested under."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Temporary folders of local sessions without a setting, by application.
_OWN: dict[str, str] = {}
#: Staged folders of the scopes that are open, the innermost last.
_SCOPES: list[list[str]] = []
#: Rows from which on a staged table of known length gets another file.
FILE_ROWS = 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder of its own; a
    cluster session without it is an error, since a machine-local folder would be
    lost with its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file:" + tempfile.mkdtemp(prefix="paragem-")
    return _OWN[context.applicationId]


def new_shared_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove the folders that were named inside the scope once it ends.

    Write what is wanted before the end: plans that read a staged table fail afterwards.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in map(hadoop, _SCOPES.pop()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    For a table that several branches of a plan read: each branch then scans only
    its own columns, nothing upstream is computed twice, and losing an executor
    costs a re-read instead of the whole lineage. The write happens on call; see
    ``staging`` for when the folder goes.

    ``rows``, if known, is about how many rows ``df`` has, narrow ones: it is then written
    by a task for each FILE_ROWS of them, if the plan does not have fewer. Without it a
    small table is as many files as there are shuffle partitions, and on a local file
    system each file has an executor start processes that set its permissions.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
