"""Training samples from solved trajectories, as one relational plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.trajectory import MIN_QUALITY, drop_repeats

#: Fixed pattern: answers that only say that there is one.
PLACEHOLDER = r"(?i)^(analysis completed with \d+ steps\.?\s*|based on the analysis steps above\.?\s*)$"


def wrapped_output(output: Column) -> Column:
    """A tool's output as JSON with its success; one that is so already stays."""
    done = output.startswith("{") & F.contains(output, F.lit('"success"'))
    return F.when(done, output).otherwise(F.to_json(F.struct((~output.startswith("ERROR:")).alias("success"), output.alias("output"))))


def is_placeholder(answer: Column) -> Column:
    return (F.trim(F.coalesce(answer, F.lit(""))) == "") | F.regexp_like(F.trim(answer), F.lit(PLACEHOLDER))


def assemble(trajectories: DataFrame, steps: DataFrame, least_quality: float = MIN_QUALITY) -> DataFrame:
    """traj_id, sample struct of every trajectory that is good enough and answers.

    trajectories: traj_id, question, answer, quality, certificate (string). steps: traj_id,
    step_idx, tool, arguments (JSON text), thought, output. Argument errors and repeated calls
    that read no data are left out, paths scrubbed, outputs wrapped. One shuffle by trajectory.
    """
    good = trajectories.where((F.col("quality") >= least_quality) & ~is_placeholder(F.col("answer")))
    data = F.col("tool").isin("execute_sql", "execute_python")
    kept = drop_repeats(steps, "traj_id", "step_idx", [F.col("tool"), F.coalesce("arguments", F.lit(""))], keep_always=data).where(~F.coalesce(F.col("output").startswith("ERROR: Bad arguments:"), F.lit(False)))
    call = F.concat(F.lit("<think>"), F.coalesce("thought", F.lit("")), F.lit("</think>\n"), F.to_json(F.struct(F.col("tool").alias("tool_name"), F.col("arguments"))))
    turn = F.array(
        F.struct(F.lit("assistant").alias("role"), X.scrub_paths(call).alias("content")),
        F.struct(F.lit("tool").alias("role"), X.scrub_paths(wrapped_output(F.coalesce("output", F.lit("")))).alias("content")),
    )
    turns = kept.groupBy("traj_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step_idx", turn.alias("t")))), lambda x: x["t"])).alias("turns"), F.count(F.lit(1)).alias("n_steps"))
    ask = F.array(F.struct(F.lit("user").alias("role"), X.scrub_paths(F.col("question")).alias("content")))
    reply = F.array(F.struct(F.lit("assistant").alias("role"), X.scrub_paths(F.col("answer")).alias("content")))
    joined = good.join(turns, "traj_id")
    return joined.select("traj_id", F.struct(F.concat(ask, "turns", reply).alias("messages"), F.struct("quality", "n_steps").alias("meta"), F.col("certificate")).alias("sample"))
