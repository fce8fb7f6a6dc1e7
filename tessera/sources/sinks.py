"""Where results go: conversation files, tasks, manifests; all written in parallel by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_SCHEMA = """task_id string, source_id string, question string, context string, deliverable string, ground_truth string, round_idx int, level int,
path array<string>, edge_kinds array<string>, source_span double, format_span double, question_type string, answer_key string,
answer_key_rows array<struct<label:string,value:double,raw:string>>"""


def write_conversations(messages: DataFrame, path: str) -> None:
    """One JSON object a line for each conversation."""
    messages.write.mode("overwrite").json(path)


def write_jsonl(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Any rows as JSON lines; files merges the parts into as many."""
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    (lines.coalesce(files) if files else lines).write.mode("overwrite").text(path)


def write_tasks(tasks: DataFrame, path: str) -> None:
    tasks.write.mode("overwrite").json(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks to replay, by their stated schema."""
    return spark.read.schema(TASK_SCHEMA).json(path)
