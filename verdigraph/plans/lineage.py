"""Cutting a plan by writing it to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: What cuts have written and nothing has removed yet: a list for the program, and one more for each scratch() that is open.
_WRITTEN: list[list[tuple[SparkSession, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master, where one machine is all there is, gets a folder of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="verdigraph-"))


def _remove(written: list[tuple[SparkSession, str]]) -> None:
    while written:
        spark, path = written.pop()
        # A session that has ended can't remove files; its folder is left to whoever owns the shared one.
        with contextlib.suppress(Exception):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remove_all() -> None:
    """Removes every folder that cuts of this program have left. Frames that read them can't be used afterwards. Runs by itself when the program ends."""
    for written in _WRITTEN:
        _remove(written)


atexit.register(remove_all)


def cut(df: DataFrame, name: str, instead_of: DataFrame | None = None, outlive: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: its plan becomes one scan, which lost executors don't lose.

    ``instead_of``, the frame of an earlier cut that nothing else reads, is removed once the new one is written. With ``outlive`` the folder
    stays when the scratch() that it is written in ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[-2 if outlive and len(_WRITTEN) > 1 else -1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if instead_of is not None:
        drop(instead_of)
    return out


def drop(df: DataFrame) -> None:
    """Removes what the cut that returned ``df`` wrote."""
    for written in _WRITTEN:
        if old := [x for x in written if x[1] == df._cut_path]:
            written.remove(old[0])
            _remove(old)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What is cut inside is removed at the end, so a result must be written, or cut with ``outlive``, before that."""
    written: list[tuple[SparkSession, str]] = []
    _WRITTEN.append(written)
    try:
        yield
    finally:
        _WRITTEN.remove(written)
        _remove(written)
