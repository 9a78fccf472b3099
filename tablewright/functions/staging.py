"""Writing an intermediate table where every executor can read it back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when the query that wrote them ends. Else they stay until the driver happens to
#: collect its garbage, and those of hundreds of small queries add up on the executors' disks.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: For Python work on whole texts: the batches that tasks hold, on both sides, are bounded by bytes.
SMALL_BATCHES = TIDY | {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

_written: list[str] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staging_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`.

    Only a session on a local master may do without one: it gets a folder that goes with the
    process. On a cluster a folder of one machine would be read back incomplete, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(
                "spark.checkpoint.dir names no folder; set it to one that all executors share"
            )
        folder = tempfile.mkdtemp(prefix="tablewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for what runs within; none changes a result."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, folder: str | None = None, partition_by: str | None = None) -> DataFrame:
    """The same rows, read back from a table written to the staging folder, or to `folder`; in a
    folder for each value of `partition_by`, if given, which has to be the last column.

    It cuts the lineage, fixes whatever was not deterministic, survives the loss of executors and,
    unlike a checkpoint, still lets later jobs read only the columns they need. The files stay
    until `drop_table` or `drop_staged`; those that it was shuffled by go at once.
    """
    path = f"{(folder or staging_folder(df.sparkSession)).rstrip('/')}/tablewright-{uuid.uuid4().hex}"
    _written.append(path)
    with settings(df.sparkSession, TIDY):
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[staged] = path
    return staged


def drop_table(staged: DataFrame) -> None:
    """Delete the table that `stage` has returned this frame for. Frames that read it fail afterwards."""
    path = _paths.pop(staged)
    _written.remove(path)
    _delete(staged.sparkSession, path)


def drop_staged(spark: SparkSession, since: int = 0) -> int:
    """Delete what this process has staged, but for the first `since` tables; return how many.

    Frames that still read those tables fail afterwards, so call it when their results are out.
    """
    gone = _written[since:]
    for path in gone:
        _delete(spark, path)
    del _written[since:]
    return len(gone)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def staged_count() -> int:
    """How many tables are staged now; a mark for `drop_staged`."""
    return len(_written)
