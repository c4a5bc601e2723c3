"""Trajectories and pose graphs: lengths, counts, corrections, loop-closure filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def path_length(nodes: DataFrame, key: str, order: list[str], axes: list[str]) -> DataFrame:
    """key, node_count, total_distance, duration of each trajectory: one shuffle on the key."""
    w = Window.partitionBy(key).orderBy(*order)
    step = sum(F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes)
    return nodes.withColumn("__step", F.sqrt(step)).groupBy(key).agg(
        F.count("*").alias("node_count"), F.coalesce(F.sum("__step"), F.lit(0.0)).alias("total_distance"),
        (F.max("timestamp_ns") - F.min("timestamp_ns")).alias("duration_ns"),
    )


def best_closures(candidates: DataFrame, least: float) -> DataFrame:
    """Of several candidates of one pair of frames, in either direction, the best score at or above the threshold."""
    pair = candidates.withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")}).where(F.col("score") >= least)
    w = Window.partitionBy("lo", "hi").orderBy(F.col("score").desc(), "candidate_id")
    return pair.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "lo", "hi")


def edge_counts(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    kinds = ("odometry", "loop_closure", "prior")
    return edges.groupBy(graph).agg(F.count("*").alias("edge_count"), *[F.count_if(F.col("type") == k).alias(f"{k}_count") for k in kinds])


def corrections(before: DataFrame, after: DataFrame, key: list[str], axes: list[str]) -> DataFrame:
    """Mean and largest move of the nodes of each trajectory (first key column)."""
    b = after.select(*key, *[F.col(a).alias(f"__{a}") for a in axes])
    move = F.sqrt(sum(F.pow(F.col(a) - F.col(f"__{a}"), 2) for a in axes))
    return before.join(b, key).groupBy(key[0]).agg(F.avg(move).alias("mean_correction"), F.max(move).alias("max_correction"))


def error_reduction(results: DataFrame) -> DataFrame:
    return results.withColumn("error_reduction", F.when(F.col("initial_error") != 0, (F.col("initial_error") - F.col("final_error")) / F.col("initial_error")))


def uncertainty(nodes: DataFrame, closures: DataFrame, key: str, order: list[str], axes: list[str]) -> DataFrame:
    """key, mean and largest uncertainty of its nodes, and its loop closures per unit of distance (null where it does not move)."""
    u = nodes.groupBy(key).agg(F.avg("uncertainty").alias("mean_uncertainty"), F.max("uncertainty").alias("max_uncertainty"))
    n = closures.groupBy(key).agg(F.count("*").alias("__n"))
    out = u.join(path_length(nodes, key, order, axes).select(key, "total_distance"), key).join(n, key, "left")
    return out.withColumn("closure_density", F.coalesce("__n", F.lit(0)) / F.nullif("total_distance", F.lit(0.0))).drop("__n", "total_distance")


def edge_consistency(edges: DataFrame, nodes: DataFrame, key: str, frame: str) -> DataFrame:
    """key, n_edges and the root mean squares translation_rms and rotation_rms_deg of what an edge's measured motion differs from that of its two nodes.

    edges(key, source, target, motion), motion being source_from_target; nodes(key, frame, pose). Edges of which an end or the motion is missing do not count."""
    end = lambda side: nodes.select(key, F.col(frame).alias(side), F.col("pose").alias(f"__{side}"))
    both = edges.where("motion is not null").join(end("source"), [key, "source"]).join(end("target"), [key, "target"])
    both = both.select(key, "motion", g.col(g.compose(g.invert(F.col("__source")), F.col("__target"))).alias("__now"))
    off = both.select(key, g.col(g.compose(g.invert(F.col("motion")), F.col("__now"))).alias("d"))
    square = lambda path, parts: sum(F.col(f"d.{path}.{c}") * F.col(f"d.{path}.{c}") for c in parts)
    angle = F.degrees(2 * F.atan2(F.sqrt(square("q", "xyz")), F.abs(F.col("d.q.w"))))
    off = off.select(key, square("t", "xyz").alias("__t"), angle.alias("__a"))
    return off.groupBy(key).agg(F.count("*").alias("n_edges"), F.sqrt(F.avg("__t")).alias("translation_rms"), F.sqrt(F.avg(F.col("__a") * F.col("__a"))).alias("rotation_rms_deg"))


def distinct_closures(candidates: DataFrame, key: str, window_ns: int) -> DataFrame:
    """candidates(key, source, target, source_ns, target_ns, score, candidate_id) with status 'accepted' or 'rejected': in the order of score (greatest first, then candidate_id), a candidate is
    rejected if one of its key that was accepted before joins the same two frames in either direction, or the same two stretches of time, both ends within window_ns.

    The greedy choice by rounds of local maxima: an open candidate that outranks all open ones near it is accepted, all near an accepted one are rejected, until none is open. Time is cut into cells
    of the window's width, so two of one cell are near each other and only the best of a cell can be next: it alone is held against the nine cells around it, and what it beats likewise. Work a round grows with the candidates, however
    crowded a cell is. A row of candidates that each outrank the next needs as many rounds as it is accepted ones long. Copies of one pair of frames shrink to their best first; null scores come last; where a time is null only the pair of frames counts."""
    from .graph import forget, written

    rank = F.struct((-F.coalesce(F.col("score"), F.lit(float("-inf")))).alias("worse"), F.col("candidate_id"))
    whole = F.col("source_ns").isNotNull() & F.col("target_ns").isNotNull()
    times = [F.when(whole, f("source_ns", "target_ns")).alias(name) for f, name in ((F.least, "early"), (F.greatest, "late"))]
    every = candidates.select(key, F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"), F.struct(rank.alias("rank"), *times).alias("b"))
    best = every.groupBy(key, "lo", "hi").agg(F.min("b").alias("b")).select(key, "b.*")
    width = F.lit(max(1, window_ns))
    best = written(best.withColumns({"ce": F.floor(F.col("early") / width), "cl": F.floor(F.col("late") / width)}))
    accepted, todo = [best.where("early is null").select(key, "rank")], written(best.where("early is not null"))
    near = (F.abs(F.col("early") - F.col("oe")) <= window_ns) & (F.abs(F.col("late") - F.col("ol")) <= window_ns)

    def around(df: DataFrame) -> DataFrame:
        df = df.select(key, F.col("rank").alias("other"), F.col("early").alias("oe"), F.col("late").alias("ol"), F.explode(F.sequence(F.col("ce") - 1, F.col("ce") + 1)).alias("ce"), "cl")
        return df.select(key, "other", "oe", "ol", "ce", F.explode(F.sequence(F.col("cl") - 1, F.col("cl") + 1)).alias("cl"))

    while not todo.isEmpty():
        lead = written(todo.groupBy(key, "ce", "cl").agg(F.min(F.struct("rank", "early", "late")).alias("b")).select(key, "ce", "cl", "b.*"))
        beaten = todo.join(around(lead), [key, "ce", "cl"]).where(near & (F.col("rank") < F.col("other"))).select(key, F.col("other").alias("rank")).distinct()
        top = written(lead.join(beaten, [key, "rank"], "left_anti"))
        out = todo.join(around(top), [key, "ce", "cl"]).where(near).select(key, "rank").distinct()  # the accepted themselves are among these
        rest = written(todo.join(out, [key, "rank"], "left_anti"))
        forget(todo)
        forget(lead)
        accepted.append(top.select(key, "rank"))
        todo = rest
    good = accepted[0]
    for x in accepted[1:]:
        good = good.unionByName(x)
    good = good.select(key, F.col("rank.candidate_id").alias("candidate_id"), F.lit("accepted").alias("status"))
    return candidates.join(good, [key, "candidate_id"], "left").withColumn("status", F.coalesce("status", F.lit("rejected"))).select(*candidates.columns, "status")
