"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(name: str = "plainspeak", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library expects. On a cluster the caller
    also sets ``spark.checkpoint.dir`` to a folder every executor can reach."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session
    gets a temporary one; any other session, ``local-cluster`` included, is refused."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    current = context.getCheckpointDir()
    if folder is None and current is not None:
        folder = current
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):  # executors of local-cluster are processes of their own
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="plainspeak-")
    if current is None:
        context.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: cuts lineage,
    survives lost executors, and gives later joins real sizes. Inside ``scratch`` it is
    removed at the end, else it stays for whoever holds the frame. ``options`` go to the writer."""
    path = work_path(df.sparkSession, name)
    if getattr(_scopes, "stack", None):
        _scopes.stack[-1].append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``stored`` writes inside, in this thread, is removed at the end, also after an error.
    Frames made inside have to be used up there."""
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    _scopes.stack.append([])
    try:
        yield
    finally:
        for path in _scopes.stack.pop():
            remove(spark, path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in whatever store it is; none is no error."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, path: str, target: str) -> None:
    """Rename within one store, making the folders above; what is gone already is no error."""
    system, place = _file_system(spark, path)
    if system.exists(place):
        goal = spark._jvm.org.apache.hadoop.fs.Path(target)
        system.mkdirs(goal.getParent())
        system.rename(place, goal)


def make_folder(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.mkdirs(place)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return []
    return sorted(x.getPath().getName() for x in system.listStatus(place))
