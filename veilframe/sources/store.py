"""The folder that driver and executors share, tables written there, and the package on the executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Paths that the running operator of this thread has made, if it deletes them at its end.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_veilframe_shipped", False):
        return
    package = Path(__file__).parents[1]
    target = Path(tempfile.mkdtemp(prefix="veilframe-")) / "veilframe_package.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))
    context._veilframe_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset on a local master."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='veilframe-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under one folder a session, which goes when the driver's Python ends."""
    context = spark.sparkContext
    root = getattr(context, "_veilframe_scratch", None)
    if root is None:
        root = context._veilframe_scratch = f"{shared_dir(spark)}/veilframe-{uuid.uuid4().hex}"
        atexit.register(_remove_quietly, spark, root)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def _remove_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        remove(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path in the shared folder through Hadoop's file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make returns, written; the tables that were written on the way are deleted."""
    made: list[str] = []
    outer = _made.set(made)
    try:
        df = make()
    except BaseException:
        _made.reset(outer)
        _removed(spark, made)
        raise
    _made.reset(outer)
    try:
        return written(df, label)
    finally:
        _removed(spark, made)


def _removed(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        remove(spark, path)
