"""Task scheduling semantics over tables: ready sets, legal moves, status reduction, feasibility, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The legal moves between task states.
MOVES = [
    ("pending", "running"), ("pending", "cancelled"), ("pending", "skipped"), ("pending", "failed"),
    ("running", "succeeded"), ("running", "failed"), ("running", "cancelled"), ("failed", "pending"),
]
TERMINAL = ("succeeded", "failed", "cancelled", "skipped")
NEEDS = ("cpu_cores", "memory_bytes", "disk_bytes", "gpu_count", "gpu_memory_bytes")


def legal_move(frm: Column, to: Column) -> Column:
    return F.concat_ws(">", frm, to).isin([f"{a}>{b}" for a, b in MOVES])


def terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def ready(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending tasks of which every dependency succeeded. tasks(task_id, status), edges(parent, child)."""
    pending = tasks.where("status = 'pending'").select("task_id")
    unmet = edges.join(tasks.where("status <> 'succeeded' or status is null").select(F.col("task_id").alias("parent")), "parent", "left_semi")
    known = edges.join(tasks.select(F.col("task_id").alias("parent")), "parent", "left_anti")  # a dependency that is no task is never met
    blocked = unmet.select("child").unionByName(known.select("child")).distinct()
    return pending.join(blocked.withColumnRenamed("child", "task_id"), "task_id", "left_anti")


def reduce_status(df: DataFrame, group: str) -> DataFrame:
    """Cancelled if any is, else failed if any did not succeed, else succeeded."""
    return df.groupBy(group).agg(
        F.when(F.bool_or(F.col("status") == "cancelled"), "cancelled").when(F.bool_or(F.col("status") != "succeeded"), "failed").otherwise("succeeded").alias("status")
    )


def infeasible(tasks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Tasks that no worker profile can hold in all five dimensions."""
    t, p = tasks.alias("t"), profiles.select(*NEEDS).distinct().alias("p")  # one row a machine type; Spark broadcasts it if it is small
    fits = [F.col(f"p.{c}") >= F.col(f"t.{c}") for c in NEEDS]
    cond = fits[0]
    for f in fits[1:]:
        cond = cond & f
    return t.join(p, cond, "left_anti")


def missing_capabilities(need: Column, have: Column) -> Column:
    return F.array_sort(F.array_except(need, have))


def input_errors(inputs: DataFrame, outputs: DataFrame, edges: DataFrame, external: DataFrame) -> DataFrame:
    """(task_id, ref, error) of inputs with no producer among the task's dependencies and not external, or with several."""
    made = edges.select(F.col("child").alias("task_id"), F.col("parent").alias("producer")).join(outputs.select(F.col("task_id").alias("producer"), "ref"), "producer")
    n = made.groupBy("task_id", "ref").agg(F.count("*").alias("n"))
    out = inputs.join(n, ["task_id", "ref"], "left").join(external.select("ref", F.lit(True).alias("ext")).distinct(), "ref", "left")
    err = F.when(F.col("n") > 1, "ambiguous").when(F.col("n").isNull() & F.col("ext").isNull(), "unresolved")
    return out.select("task_id", "ref", err.alias("error")).where("error is not null")


def resolve_inputs(inputs: DataFrame, produced: DataFrame) -> DataFrame:
    """Placeholders replaced by the real references: produced(placeholder, ref)."""
    return inputs.join(produced.select(F.col("placeholder").alias("ref"), F.col("ref").alias("real")), "ref", "left").select("task_id", F.coalesce("real", "ref").alias("ref"))


def resume(tasks: DataFrame) -> DataFrame:
    """After a crash: running tasks are pending again with no attempts."""
    run = F.col("status") == "running"
    return tasks.withColumns({"attempts": F.when(run, 0).otherwise(F.col("attempts")), "status": F.when(run, "pending").otherwise(F.col("status"))})


def cache_hits(tasks: DataFrame, entries: DataFrame, manifests: DataFrame) -> DataFrame:
    """Tasks that need not run: deterministic, cacheable, their key known and the entry's payload present."""
    live = entries.join(manifests.select("content_hash").distinct(), "content_hash", "left_semi").select("cache_key", F.lit(True).alias("__hit")).distinct()
    out = tasks.join(live, "cache_key", "left")
    return out.withColumn("cache_hit", F.col("deterministic") & F.col("cacheable") & F.coalesce("__hit", F.lit(False))).drop("__hit")


def illegal_history(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Entries of a status log that no legal move leads to."""
    from pyspark.sql import Window

    prev = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("prev", prev).where(F.col("prev").isNotNull() & ~legal_move(F.col("prev"), F.col("status")))


def dispatched(runs: DataFrame, most_attempts: int) -> DataFrame:
    """task_id, status, attempts of each task's dispatch. runs(task_id, attempt from 1, outcome, recoverable): a
    recoverable failure is tried again while attempts are left; the first other outcome, or the last attempt, stands."""
    last = (F.col("outcome") != "failed") | ~F.col("recoverable") | (F.col("attempt") >= most_attempts)
    done = runs.where(last).groupBy("task_id").agg(F.min(F.struct("attempt", "outcome")).alias("r"))
    every = runs.groupBy("task_id").agg(F.max("attempt").alias("tried")).join(done, "task_id", "left")
    return every.select("task_id", F.coalesce("r.outcome", F.lit("pending")).alias("status"), F.coalesce("r.attempt", "tried").cast("long").alias("attempts"))
