"""SparkSession factory with the settings the library relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

R = TypeVar("R")


def within(spark: SparkSession, seconds: float, action: Callable[[], R]) -> R | None:
    """What action gives, or None where its jobs took longer; they are cancelled by a tag, and no others.

    Only that cancellation gives None. Whatever else fails is raised, also where the time is over.
    """
    context, tag = spark.sparkContext, f"within-{uuid.uuid4().hex}"
    timer = threading.Timer(max(0.0, seconds), context.cancelJobsWithTag, (tag,))
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if tag in str(e):  # Spark names the tag that it cancelled a job by
            return None
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where that is unset a local master gets a temporary folder; on a cluster it is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df computed and kept in the shared folder, its lineage cut; a lost executor costs a re-read."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def get_session(app: str = "tessera", cpus: str | int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches.

    On a cluster the session comes from spark-submit and nothing here overrides it.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
