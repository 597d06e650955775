"""Session settings that the operators assume."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "peakloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers: nothing to do where they inherit a path to it, else it goes along as a zip, once a context."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if any(p and os.path.realpath(p) == os.path.realpath(root) for p in paths) or getattr(context, "_peakloom_shipped", False):
        return
    at = tempfile.mkdtemp(prefix="peakloom-ship-")  # the driver's own, which it serves to executors until it ends
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{at}/peakloom", "zip", root, "peakloom"))
    context._peakloom_shipped = True


_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), deleted when the application ends. Where the
    setting is unset: a folder of our own in local mode (tests), else an error, for executors couldn't see that."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="peakloom-")
            atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
        root = f"file://{_OWN['dir']}"
    own = f"{root.rstrip('/')}/peakloom-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return f"{own}/{uuid.uuid4().hex}/{label}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back: its plan runs once however often it is used, and lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, rows: int = 500_000, times: float = 1.0) -> int:
    """How many partitions hold df, whose rows become `times` as many, in shares of about that many rows: what a task sorts or sums is the
    same whatever the size, while a setting for shuffles is fixed and lets it grow with the input."""
    return max(1, math.ceil(df.count() * times / rows))
