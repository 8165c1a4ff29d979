"""Session defaults and shared scratch tables."""

from __future__ import annotations

import gc
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "flowsentry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; keyword dots are ``__``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="flowsentry-")
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return os.path.join(scratch_root(spark), "flowsentry", app, f"{label}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, label: str = "table", spread: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage before a frame is scanned repeatedly (iterative fits, multi-pass
    metrics). A written table outlives any executor and keeps column pruning. With
    ``spread``, a table that fills fewer partitions than there are cores, or files than half of
    them, is dealt out over all of them; larger tables are left as they are. ``by`` names columns with few
    values that become folders, so that a filter on them reads no other rows.
    """
    back = _write(df, label, by)
    if spread:
        # A file below the size of a row group is read by one task, however many pieces it is cut into.
        cores = df.sparkSession.sparkContext.defaultParallelism
        if min(back.rdd.getNumPartitions(), 2 * len(back.inputFiles())) < cores:
            narrow, back = back, _write(back.repartition(cores), label)
            release(narrow)
    return back


def spread_small(scan: DataFrame) -> DataFrame:
    """Deal a file scan out over all cores if its files fill fewer partitions than that.

    Only small sources are shuffled; pass a plain scan, whose partitions are known.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application: call it once their results are stored."""
    _delete(spark, os.path.join(scratch_root(spark), "flowsentry", spark.sparkContext.applicationId))


def drop_shuffles(spark: SparkSession) -> None:
    """Let the executors delete the shuffle files of finished work now.

    Spark does so when the driver's JVM happens to collect what refers to them, which a driver with
    little to do puts off while disks fill. Call it after steps that shuffle more than they keep.
    """
    gc.collect()  # Python's objects hold on to the JVM's
    spark._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Delete the scratch table that ``materialise`` gave as ``df``, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _write(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """Store one small JSON document on the cluster's file system."""
    frame = spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1)
    frame.write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).filter("value != ''").head().value)
