"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, name: str = "furrow", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    Nothing here is needed for right results except the UTC time zone; a
    cluster's own settings for memory and parallelism are left alone.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("FURROW_DRIVER_MEMORY", "8g"))
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_own_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's shared checkpoint
    folder, or a temporary one in local mode, where all tasks share the machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch folder; no two calls share one."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df, spark: SparkSession, label: str):
    """Cut the lineage of ``df`` through a table in the shared folder, which
    outlives the executors that wrote it."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df, *keys):
    """``df`` dealt by ``keys`` over as many tasks as a shuffle has, however few bytes it
    holds. For rows that a step multiplies, which sizes before that step do not show,
    and for aggregates that would sort a whole input file in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for operators that run Python there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "furrow"), "zip", os.path.dirname(package), os.path.basename(package)
        )
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
