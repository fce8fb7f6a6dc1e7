"""Extensions: the same relations over unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, by, n, total: counts in tumbling or sliding windows, with a watermark where the input is a stream."""
    kept = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    kept = kept.withWatermark("_ts", late) if events.isStreaming else kept
    grouped = kept.groupBy(F.window("_ts", window, slide).alias("w") if slide else F.window("_ts", window).alias("w"), by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, start, n: sessions that end after a gap."""
    kept = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    kept = kept.withWatermark("_ts", late) if events.isStreaming else kept
    return kept.groupBy(F.session_window("_ts", gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").cast("timestamp_ntz").alias("start"), "n")


def running_failures(results: DataFrame, key: str = "run_id", ok: str = "success", share: float = 0.6, least: int = 10) -> DataFrame:
    """key, n, failed, abort per run as results arrive: a run is to stop once more than `share` of `least` or more failed."""

    def fold(run: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, failed = state.get if state.exists else (0, 0)
        for batch in batches:
            n, failed = n + len(batch), failed + int((~batch[ok].astype(bool)).sum())
        state.update((n, failed))
        yield pd.DataFrame({key: [run[0]], "n": [n], "failed": [failed], "abort": [n >= least and failed / n > share]})

    kind = results.schema[key].dataType.simpleString()
    return results.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n bigint, failed bigint, abort boolean", "n bigint, failed bigint", "update", GroupStateTimeout.NoTimeout)
