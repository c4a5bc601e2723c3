"""Levels of detail: cuts through a graph of geometry elements from coarse to fine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import forget, written


def cut(elements: DataFrame, edges: DataFrame, stop: Column) -> DataFrame:
    """element_id, depth, exact: the elements to show, top down from those without a parent.

    An element is shown if `stop` (a condition on columns of elements; null counts as no) holds, else its children stand for it; one without children is shown as it is,
    with exact false. elements(element_id, ...), edges(parent, child) from coarse to fine; edges to or from unknown elements count for nothing. A child that several
    parents share is taken once, at its least depth. An element may lie below one that is shown, if another of its parents is refined. What only a cycle reaches has no
    root and is not shown. Each round joins the new frontier alone."""
    known = elements.select("element_id", F.coalesce(stop, F.lit(False)).alias("stop"))
    ids = known.select("element_id")
    inner = edges.select("parent", "child").where("parent <> child").distinct()
    inner = inner.join(ids.withColumnRenamed("element_id", "parent"), "parent", "left_semi").join(ids.withColumnRenamed("element_id", "child"), "child", "left_semi")
    inner = written(inner)
    fine = inner.select(F.col("parent").alias("element_id")).distinct().withColumn("fine", F.lit(True))
    graph = written(known.join(fine, "element_id", "left").select("element_id", "stop", F.coalesce("fine", F.lit(False)).alias("fine")))
    front = written(graph.join(inner.select(F.col("child").alias("element_id")), "element_id", "left_anti").withColumn("depth", F.lit(0)))
    seen, depth = front, 0
    while True:
        depth += 1
        down = front.where("not stop and fine").select(F.col("element_id").alias("parent"))
        nxt = inner.join(down, "parent").select(F.col("child").alias("element_id")).distinct().join(seen.select("element_id"), "element_id", "left_anti")
        front = written(graph.join(nxt, "element_id").select(*graph.columns, F.lit(depth).alias("depth")))
        if front.isEmpty():
            forget(inner)
            return seen.where("stop or not fine").select("element_id", "depth", F.col("stop").alias("exact"))
        seen = seen.unionByName(front)


def under_error(bound: float, error: str = "error") -> Column:
    """Stops at elements whose error is within the bound; an unknown error is refined."""
    return F.col(error) <= F.lit(bound)


def at_level(level: int, column: str = "level") -> Column:
    """Stops at elements of the asked level or a finer one, where a chain skips it."""
    return F.col(column) >= F.lit(level)
