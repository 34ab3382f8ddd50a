"""Session helpers shared by the tests, the benchmark and applications."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "veilscan") -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VEILSCAN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        # plans here have thousands of expressions; recording the call site of each takes most of the build time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder for written tables, below the checkpoint folder of the session.

    Clusters name a folder all executors see in ``spark.checkpoint.dir``; only where it
    is unset (local tests) a folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="veilscan-")
    return f"{base.rstrip('/')}/veilscan-{uuid.uuid4().hex}"


# Rows of a spread table that one task searches, some seconds of work.
ROWS_A_TASK = 20_000


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that arrives in few or uneven splits, and every task a bounded number of rows.

    Detection costs far more than moving the text, so idle cores are worse than the exchange. A split of a Parquet table may hold
    millions of short rows or, between the beginnings of its row groups, none; so the tasks follow from the number of rows. An input
    with as many splits is left alone. Only for plain scans: the plan of ``df`` is asked for its partitions and rows, which would run
    the exchanges of a deeper plan.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
