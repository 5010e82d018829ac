"""Session settings shared by the command line, the tests and the benchmark."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession


def get_spark(app: str = "odweave", cores: int | str | None = None) -> SparkSession:
    """The running session as it is, else a new one: local unless SPARK_MASTER names a cluster, whose settings then hold."""
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    n = cores or os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    master = os.environ.get("SPARK_MASTER")
    if master:
        return builder.master(master).getOrCreate()
    local = {
        "spark.sql.shuffle.partitions": os.environ.get("ODWEAVE_PARTITIONS", "8"), "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("ODWEAVE_DRIVER_MEMORY", "12g"), "spark.driver.host": "127.0.0.1",
    }
    return builder.master(f"local[{n}]").config(map=local).getOrCreate()


def slots(spark: SparkSession) -> int:
    """Tasks that can run at one time, as far as the settings tell; what a barrier stage may have."""
    context = spark.sparkContext
    conf = context.getConf()
    local = re.match(r"local(?:\[(\d+|\*).*\])?$", context.master)
    if local:
        cores = context._jvm.Runtime.getRuntime().availableProcessors() if local[1] == "*" else int(local[1] or 1)
    elif conf.contains("spark.default.parallelism"):  # set by hand, so it tells nothing about cores
        cores = max(1, context._jsc.sc().getExecutorMemoryStatus().size() - 1) * int(conf.get("spark.executor.cores", "1"))
    else:
        cores = context.defaultParallelism
    return max(1, cores // int(conf.get("spark.task.cpus", "1")))
