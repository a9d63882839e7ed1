"""Session helpers: shipping the package to Python workers and shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each SparkContext.

    The archive is served by the driver through ``addPyFile``; executors need no
    copy of the repository and no shared folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_latticelake_shipped", False):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="latticelake-")), "latticelake_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, str(Path(PACKAGE.name) / f.relative_to(PACKAGE)))
    sc.addPyFile(path)
    sc._latticelake_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is read from the session; only where it is unset and the master is local (tests) a
    temporary folder stands for it. On a cluster no machine-local folder is used.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(sc, "_latticelake_scratch", None)
        if root is None:
            root = sc._latticelake_scratch = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="latticelake-shared-"))
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    sc = spark.sparkContext
    path = f"{scratch_root(spark)}/{sc.applicationId}/{tag}-{uuid.uuid4().hex}"
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that runs in here are deleted when it has ended, rather than when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, unlike a cache or
    a local checkpoint.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with tidied(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._latticelake_path = path
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files behind materialized tables that nothing reads any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "_latticelake_path", None)):
            remove(df.sparkSession, path)
