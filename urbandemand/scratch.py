"""Shared scratch tables: cut lineage without tying rows to an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir`` and has to; only on a local
    master, where it may be unset, a temporary folder is made and kept.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_own_shared_dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master!r} share")
        path = spark._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="urbandemand-")
    return path.rstrip("/")


_REMOVE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what runs inside go as soon as it is done."""
    before = spark.conf.get(_REMOVE, None)
    spark.conf.set(_REMOVE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_REMOVE) if before is None else spark.conf.set(_REMOVE, before)


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage without tying the rows to an executor's disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    made = _made.get()
    if made is not None:
        made.append(out)
    return out


#: Tables stored within the innermost ``scratch``.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drops at its end the tables stored inside, but those given to the function it yields.

    What is returned from inside may read kept tables only.
    """
    made: list[DataFrame] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._stored_path)
        return df

    token = _made.set(made)
    try:
        yield keep
    finally:
        _made.reset(token)
        dropped(*(df for df in made if df._stored_path not in kept))
    outer = _made.get()
    if outer is not None:
        outer += [df for df in made if df._stored_path in kept]


def _path(df: DataFrame):
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def dropped(*frames: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing reads it any more."""
    for df in frames:
        path, system = _path(df)
        system.delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``stored`` wrote."""
    path, system = _path(df)
    return system.getContentSummary(path).getLength()
