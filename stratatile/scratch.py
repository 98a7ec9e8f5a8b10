"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables that are still there, and the session that wrote them.
_HELD: dict[str, SparkSession] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only a local session may go without that setting; it then uses the
    temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'stratatile-checkpoints')}"


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``by``: a column of few values; what filters one of them reads no others.
    The table stays until it is discarded, its block of ``cleared`` ends, or Python does.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/stratatile-{name}-{uuid.uuid4().hex}"
    _HELD[path] = spark
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._scratch = path
    return read


def _delete(path: str) -> None:
    spark = _HELD.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that no frame still in use reads."""
    for t in tables:
        _delete(getattr(t, "_scratch", ""))


@contextlib.contextmanager
def cleared(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes at its end every table written inside, but for those put into the list that it gives."""
    before, stay = set(_HELD), list(kept)
    try:
        yield stay
    finally:
        for path in set(_HELD) - before - {getattr(t, "_scratch", "") for t in stay}:
            _delete(path)


@atexit.register
def _clear() -> None:
    for path in list(_HELD):
        with contextlib.suppress(Exception):  # the session may be gone already
            _delete(path)
