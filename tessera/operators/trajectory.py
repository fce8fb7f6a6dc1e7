"""Trajectories as relations: step classes, runs of errors, duplicates, ranks, and the export form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import order

SUBSTANTIVE_SCORE, MIN_QUALITY, MAX_STEPS, LAST_KEPT = 0.5, 0.45, 20, 10
ACCEPT_CUTS = {"all": 0.0, "partial": 0.5, "fact": 0.9, "exact": 0.99}
EARLY_ABORT_SHARE, EARLY_ABORT_LEAST = 0.6, 10
#: Phases of an analysis, in order.
PHASES = ("discover", "schema", "query", "compute", "verify", "answer")


def adjacent(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Each assistant message with the message right after it, where that is a tool's or, in plain talks, a user's."""
    w = Window.partitionBy(key).orderBy(order)
    seen = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    return seen.where(F.col("role") == "assistant")


def classify_steps(steps: DataFrame, key: str = "traj_id", order: str = "step_idx") -> DataFrame:
    """steps with data_step, metadata_only, resolved_prior_error and error_run (errors in a row up to the step)."""
    w = Window.partitionBy(key).orderBy(order)
    data = F.col("tool").isin("execute_sql", "execute_python") & ~X.is_metadata_query(F.col("text"))
    marked = steps.withColumn("metadata_only", X.is_metadata_query(F.col("text"))).withColumn("data_step", data & F.col("success") & (F.trim(F.coalesce("output", F.lit(""))) != ""))
    marked = marked.withColumn("resolved_prior_error", F.coalesce(F.col("success") & ~F.lag("success").over(w), F.lit(False)))
    return error_runs(marked, key, order, ~F.col("success"))


def error_runs(rows: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """rows with error_run: how many failures in a row end here. Islands are numbered by the successes before them."""
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = rows.withColumn("_f", failed.cast("int")).withColumn("_i", F.sum(1 - F.col("_f")).over(upto))
    within = Window.partitionBy(key, "_i").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return island.withColumn("error_run", F.sum("_f").over(within)).drop("_f", "_i")


def drop_repeats(steps: DataFrame, key: str, order: str, signature: Sequence[Column], keep_always: Column | None = None, least: int = 3) -> DataFrame:
    """Steps without exact repeats of earlier ones, in trajectories of more than `least` steps; those of keep_always stay."""
    sig = F.sha2(F.concat_ws("|", *signature), 256)
    seen = steps.withColumn("_s", sig)
    seen = seen.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_s").orderBy(order))).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(key)))
    stay = (F.col("_n") == 1) | (F.col("_all") <= least)
    return seen.where(stay | keep_always if keep_always is not None else stay).drop("_s", "_n", "_all")


def last_kept(rows: DataFrame, key: str, order: str, most: int = LAST_KEPT) -> DataFrame:
    """The last `most` rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= most).drop("_r")


def best_so_far(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with best (running maximum) and improved."""
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("best", F.max(value).over(upto)).withColumn("improved", F.coalesce(F.col(value) > F.max(value).over(before), F.lit(True)))


def rank_trajectories(trajectories: DataFrame, task: str = "task_id") -> DataFrame:
    """The best trajectory of each task: data steps done, quality, ended with an answer, more steps; ties by the largest id."""
    order = F.struct((F.col("data_steps") >= 1).alias("did"), "quality", "ended", "n_steps", "traj_id")
    return trajectories.groupBy(task).agg(F.max_by("traj_id", order).alias("traj_id"), F.max(order).alias("_best")).select(task, "traj_id", F.col("_best.quality").alias("quality"), F.col("_best.n_steps").alias("n_steps"))


def accepted(v_q: Column, rule: str = "fact") -> Column:
    return v_q + 1e-9 >= ACCEPT_CUTS[rule]


def heuristic(steps: DataFrame, key: str = "traj_id", phase: str = "phase") -> DataFrame:
    """v_h of each trajectory: the mean of progress, data coverage, tool success and non-redundancy."""
    place = F.coalesce(*[F.when(F.max(phase) == p, i / (len(PHASES) - 1)) for i, p in enumerate(PHASES)], F.lit(0.0))
    sig = F.sha2(F.concat_ws("|", "tool", F.substring("text", 1, 120)), 256)
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    terms = steps.groupBy(key).agg(
        place.alias("progress"),
        F.least(F.count_if("data_step") / MAX_STEPS, F.lit(1.0)).alias("data_coverage"),
        (F.count_if("success") / n).alias("tool_success"),
        F.greatest(F.lit(0.0), 1 - (n - F.count_distinct(sig)) / n).alias("non_redundancy"),
    )
    return terms.withColumn("v_h", (F.col("progress") + F.col("data_coverage") + F.col("tool_success") + F.col("non_redundancy")) / 4)


def level(column: Column) -> Column:
    """1, 2 or 3 from a level or an M-prefixed motif; anything else is 1."""
    n = F.regexp_replace(F.coalesce(column.cast("string"), F.lit("0")), "^[Mm]+", "").try_cast("int")
    return F.when(n.isin(1, 2, 3), n).otherwise(1)


def parents(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaf, node_id, hops: the way from each leaf to its root, of any length, in rounds by the logarithm of the longest."""
    return order.ways_up(nodes, leaves)


def to_messages(rows: DataFrame, key: str, order: str, role: str = "role", content: str = "text", most: int | None = None) -> DataFrame:
    """key, messages, n_messages: a conversation's messages in order, as an array of structs, paths scrubbed."""
    text = X.scrub_paths(F.col(content))
    message = F.struct(F.col(order).alias("at"), F.col(role).alias("role"), (X.cut_to(text, most) if most else text).alias("content"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(message)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")).withColumn("n_messages", F.size("messages"))


def samples(messages: DataFrame, key: str) -> DataFrame:
    """key, sample: the exported JSON text of each conversation."""
    return messages.select(key, F.to_json(F.struct("messages")).alias("sample"))


def manifest(results: DataFrame, success: Column, cost: Column) -> DataFrame:
    """One row of totals: n, n_success, success_rate, total_cost, mean_cost."""
    return results.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(success).alias("n_success"), (F.count_if(success) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("success_rate"),
        F.sum(cost.cast("decimal(28,6)")).cast("double").alias("total_cost"), (F.sum(cost.cast("decimal(28,6)")).cast("double") / F.count(F.lit(1))).alias("mean_cost"),
    )


def unfinished(tasks: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    return tasks.join(finished.select(key).distinct(), key, "left_anti")


def evict(nodes: DataFrame, share: int = 4) -> DataFrame:
    """The worst quarter of leaves: oldest and least rewarded first (age less a hundred times the mean reward)."""
    worst = F.desc(F.col("age") - 100 * F.col("avg_reward"))
    return order.first_share(nodes.where("is_leaf"), [worst, F.asc("node_id")], share)
