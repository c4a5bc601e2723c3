"""Frame trees and dependency graphs.

All are rounds of joins over a frontier that is deduplicated and written each round;
a recursive query would repeat a node of a graph once a path. Calling them runs jobs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def shared_folder(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Only in
    local mode, where all is one machine, a folder of our own is made if none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="karstline-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder; lineage ends there."""
    spark = df.sparkSession
    base = shared_folder(spark)
    path = f"{base}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a written table that no later plan reads."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ancestors(tree: DataFrame, most_levels: int = 64) -> DataFrame:
    """frame_id, ancestor_id, up: every frame with each frame above it, in rounds that climb one level."""
    edge = tree.where("parent_id is not null").select("frame_id", "parent_id")
    step = written(edge.select("frame_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("up")))
    out = step
    for up in range(2, most_levels + 2):
        above = edge.select(F.col("frame_id").alias("ancestor_id"), F.col("parent_id").alias("next"))
        step = written(step.join(above, "ancestor_id").select("frame_id", F.col("next").alias("ancestor_id"), F.lit(up).alias("up")))
        if step.isEmpty():
            return out
        out = out.unionByName(step)
    raise ValueError(f"deeper than {most_levels} levels, or a cycle")


def add_frames(known: DataFrame, batch: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with error) of batch(frame_id, parent_id, ...) as if its rows were added one after another in the order of `seq`, which tells rows apart.

    A row is refused with 'exists' if its id is known or was accepted before, else with 'parent_not_found' if its parent is neither known nor accepted before it. A refused row takes nothing:
    a later one may have its id, and its children find no parent. Each round decides all rows that wait for nothing: the first open row of an id whose parent
    is there, or can't come in time any more. Rounds are as many as the batch has levels; the first open row always is one of those decided."""
    names = batch.columns
    place = F.col(seq).cast("long").alias("__seq")
    todo = written(batch.select("frame_id", "parent_id", place))
    taken = known.select("frame_id", F.lit(-(1 << 63)).cast("long").alias("at")).distinct()
    decided = []
    while not todo.isEmpty():
        first = todo.groupBy("frame_id").agg(F.min("__seq").alias("first"))
        own = taken.select("frame_id", F.lit(True).alias("there"))
        up = taken.select(F.col("frame_id").alias("parent_id"), F.col("at").alias("parent_at"))
        open_up = first.select(F.col("frame_id").alias("parent_id"), F.col("first").alias("parent_open"))
        j = todo.join(first, "frame_id").join(own, "frame_id", "left").join(up, "parent_id", "left").join(open_up, "parent_id", "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("__seq"), F.lit(False))
        turn = F.col("__seq") == F.col("first")
        what = F.when(F.col("there"), "exists").when(turn & (F.col("parent_id").isNull() | before("parent_at")), "").when(turn & ~before("parent_open"), "parent_not_found")
        now = written(j.select("frame_id", "parent_id", "__seq", what.alias("error")))
        forget(todo)
        taken = taken.unionByName(now.where("error = ''").select("frame_id", F.col("__seq").alias("at")))
        decided.append(now.where("error is not null").select("__seq", "error"))
        todo = written(now.where("error is null").select("frame_id", "parent_id", "__seq"))
    if not decided:
        return batch.limit(0), batch.limit(0).withColumn("error", F.lit(None).cast("string"))
    every = decided[0]
    for x in decided[1:]:
        every = every.unionByName(x)
    out = batch.withColumn("__seq", F.col(seq).cast("long")).join(every, "__seq")
    return out.where("error = ''").select(*names), out.where("error <> ''").select(*names, "error")


def frame_problems(tree: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """frame_id, problem of frames that no chain of parents leads to a root: 'dangling' if the chain ends at an
    unknown parent, 'cycle' if it never ends. Rounds by pointer doubling, so a chain of n frames takes log n of them."""
    ids = tree.select(F.col("frame_id").alias("up"), F.lit(True).alias("__known"))
    link = tree.select("frame_id", F.col("parent_id").alias("up")).join(ids, "up", "left")
    end = F.when(F.col("up").isNull(), "root").when(F.col("__known").isNull(), "dangling")
    state = written(link.select("frame_id", "up", end.alias("end")))
    left = None
    for _ in range(most_rounds):
        n = state.where("end is null").count()
        if not n or n == left:
            # as many unsettled frames as before: their chains only go round
            return state.select("frame_id", F.coalesce("end", F.lit("cycle")).alias("problem")).where("problem <> 'root'")
        left = n
        above = state.select(F.col("frame_id").alias("up"), F.col("up").alias("up2"), F.col("end").alias("end2"))
        new = written(state.join(above, "up", "left").select("frame_id", F.coalesce("up2", "up").alias("up"), F.coalesce("end", "end2").alias("end")))
        forget(state)
        state = new
    raise ValueError("too many rounds")


def validate_frames(tree: DataFrame) -> DataFrame:
    """One row (valid, reason): a cycle or a dangling parent comes first, then an empty graph, then the number of roots."""
    bad = frame_problems(tree).agg((F.count("*") > 0).alias("broken"))
    n = tree.agg(F.count("*").alias("n"), F.coalesce(F.count_if(F.col("parent_id").isNull()), F.lit(0)).alias("roots"))
    reason = F.when(F.col("broken"), "cycle").when(F.col("n") == 0, "empty").when(F.col("roots") > 1, "multiple_roots").when(F.col("roots") == 0, "no_root")
    return n.crossJoin(bad).select(reason.isNull().alias("valid"), reason.alias("reason"))  # one row each


def transforms_to_root(tree: DataFrame, most_levels: int = 64) -> DataFrame:
    """frame_id, root_id, depth and root_from_frame of every frame that reaches a root.

    tree(frame_id, parent_id, pose): parent_from_child poses. Rounds of joins up the
    tree, one a level; a cycle or a dangling parent never reaches a root and is absent.
    """
    up = tree.where("parent_id is null").select("frame_id", F.col("frame_id").alias("root_id"), F.lit(0).alias("depth"), F.col("pose"))
    out, level = up, up
    edges = tree.where("parent_id is not null").select("frame_id", "parent_id", F.col("pose").alias("own"))
    for depth in range(1, most_levels + 1):
        parents = level.select(F.col("frame_id").alias("parent_id"), "root_id", F.col("pose").alias("above"))
        level = written(edges.join(parents, "parent_id").select("frame_id", "root_id", F.lit(depth).alias("depth"), g.col(g.compose(F.col("above"), F.col("own"))).alias("pose")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"deeper than {most_levels} levels")


def climbs(tree: DataFrame, start: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """frame_id, ancestor_id, pose (ancestor from frame) of start(frame_id) with each frame above it, in rounds that climb one level. A frame that is met
    again ends its climb, so cycles end too; the chain may also end at an unknown parent."""
    edge = tree.where("parent_id is not null").select(F.col("frame_id").alias("ancestor_id"), "parent_id", F.col("pose").alias("own"))
    there = tree.select(F.col("frame_id").alias("ancestor_id"))
    one = F.struct(F.struct(*[F.lit(v).alias(c) for c, v in zip("xyzw", (0.0, 0.0, 0.0, 1.0))]).alias("q"), F.struct(*[F.lit(0.0).alias(c) for c in "xyz"]).alias("t"))
    step = start.select("frame_id", F.col("frame_id").alias("ancestor_id"), one.alias("pose")).distinct()
    out = None
    for _ in range(most_levels):
        up = step.join(edge, "ancestor_id").select("frame_id", F.col("parent_id").alias("ancestor_id"), g.col(g.compose(F.col("own"), F.col("pose"))).alias("pose"))
        up = up.join(there, "ancestor_id", "left_semi").where("ancestor_id <> frame_id")
        step = up if out is None else up.join(out.select("frame_id", "ancestor_id"), ["frame_id", "ancestor_id"], "left_anti")
        step = written(step.select("frame_id", "ancestor_id", "pose"))
        if step.isEmpty():
            return step if out is None else out
        out = step if out is None else out.unionByName(step)
    raise ValueError(f"deeper than {most_levels} levels")


def frame_transform(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(frm, dst) with pose, frm_from_dst, and error: one row a pair, whatever is asked.

    Equal ids give the identity, known or not. An unknown id is 'not_found'. If frm stands above dst, or dst above frm, the pose is that of the chain between; it needs no root. Else 'cycle' if
    the climb from dst, or then from frm, goes round, and 'disconnected' otherwise, siblings included."""
    asked = pairs.select("frm", "dst").distinct()
    ends = asked.select(F.col("frm").alias("frame_id")).union(asked.select("dst")).distinct()
    line = climbs(tree, ends.join(tree.select("frame_id"), "frame_id", "left_semi"))
    round_ = frame_problems(tree).where("problem = 'cycle'").select("frame_id")
    flag = lambda df, key, name: df.select(F.col("frame_id").alias(key), F.lit(True).alias(name)).distinct()
    out = asked
    for key in ("frm", "dst"):
        out = out.join(flag(tree, key, f"has_{key}"), key, "left").join(flag(round_, key, f"round_{key}"), key, "left")
    out = out.join(line.toDF("dst", "frm", "down"), ["frm", "dst"], "left").join(line.toDF("frm", "dst", "up"), ["frm", "dst"], "left")
    same = F.col("frm") == F.col("dst")
    error = F.when(same, None).when(F.col("has_frm").isNull() | F.col("has_dst").isNull(), "not_found").when(F.col("down").isNotNull(), None).when(F.col("round_dst"), "cycle")
    error = error.when(F.col("up").isNotNull(), None).when(F.col("round_frm"), "cycle").otherwise("disconnected")
    one = g.pose(g.quat(0, 0, 0, 1), g.vec(0, 0, 0))
    out = out.withColumn("error", error)
    pose = F.when(same, g.col(one)).when(F.col("error").isNull() & F.col("down").isNotNull(), F.col("down")).when(F.col("error").isNull(), g.col(g.invert(F.col("up"))))
    return pairs.join(out.select("frm", "dst", pose.alias("pose"), "error"), ["frm", "dst"])


def closure(edges: DataFrame, start: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """node, level: everything that start(node) depends on along edges(parent, child), each node once at its least level.
    A round writes its frontier alone; what was seen is the union of the frontiers."""
    front = written(start.select("node").distinct().withColumn("level", F.lit(0)))
    seen = front
    for level in range(1, most_rounds + 1):
        nxt = edges.join(front.select(F.col("node").alias("child")), "child").select(F.col("parent").alias("node")).distinct()
        front = written(nxt.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise ValueError("too many rounds")


def longest_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level: the longest path from a node without parents; nodes on or behind a cycle have no level.

    Kahn's algorithm by rounds: one table a level, the nodes not yet placed with the number of
    parents they wait for, from which the children of the nodes just placed take off their share.
    """
    edges = written(edges.select("parent", "child").distinct())
    n = edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("wait"))
    wait = written(nodes.select("node").distinct().join(n, "node", "left").withColumn("wait", F.coalesce("wait", F.lit(0))))
    out, level = None, 0
    while True:
        ready = wait.where("wait = 0")
        if ready.isEmpty():
            return out if out is not None else ready.select("node", F.lit(0).alias("level"))
        placed = ready.select("node", F.lit(level).alias("level"))
        out = placed if out is None else out.unionByName(placed)
        less = edges.join(ready.select(F.col("node").alias("parent")), "parent").groupBy(F.col("child").alias("node")).agg(F.count("*").alias("less"))
        rest = wait.where("wait > 0").join(less, "node", "left")
        wait = written(rest.select("node", (F.col("wait") - F.coalesce("less", F.lit(0))).alias("wait")))
        level += 1


def topological_order(edges: list[tuple[str, str]], nodes: list[str]) -> list[str]:
    """First-in-first-out order of a plan's few tasks on the driver; a cycle raises."""
    from collections import deque

    edges = list(dict.fromkeys(edges))
    need = {n: 0 for n in nodes}
    after: dict[str, list[str]] = {n: [] for n in nodes}
    for parent, child in edges:
        need[child] += 1
        after[parent].append(child)
    queue, out = deque(n for n in nodes if not need[n]), []
    while queue:
        n = queue.popleft()
        out.append(n)
        for c in after[n]:
            need[c] -= 1
            if not need[c]:
                queue.append(c)
    if len(out) < len(nodes):
        raise ValueError("the graph has a cycle")
    return out


def spread_failure(status: DataFrame, edges: DataFrame, mark: str = "skipped") -> DataFrame:
    """node, status: pending nodes behind a failed, cancelled or skipped one get `mark`, to a fixpoint."""
    bad = status.where("status in ('failed', 'cancelled', 'skipped')").select("node")
    reach = written(bad.distinct())
    front = reach
    pending = status.where("status = 'pending'").select("node")
    while True:
        nxt = edges.join(front.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct()
        front = written(nxt.join(pending, "node", "left_semi").join(reach, "node", "left_anti"))
        if front.isEmpty():
            break
        reach = written(reach.unionByName(front))
    hit = reach.withColumn("__hit", F.lit(True))
    return status.join(hit, "node", "left").select("node", F.when(F.col("__hit") & (F.col("status") == "pending"), mark).otherwise(F.col("status")).alias("status"))


def executed(results: DataFrame, edges: DataFrame, mark: str = "skipped") -> DataFrame:
    """node, status at the end of a run: what a task's dispatch gives if everything it depends on succeeds, else
    `mark`. results(node, status): the outcome of each task if it is dispatched. Tasks behind one that is
    still pending stay pending, unless another one above them has failed."""
    down = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    bad = results.where("status not in ('succeeded', 'pending')").select("node")
    wait = results.where("status = 'pending'").select("node")
    children = lambda top: edges.join(top.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node"))
    below = lambda top: closure(down, children(top)).select("node")
    out = results.join(below(bad).withColumn("__bad", F.lit(True)), "node", "left").join(below(wait).withColumn("__wait", F.lit(True)), "node", "left")
    return out.select("node", F.when(F.col("__bad"), mark).when(F.col("__wait"), "pending").otherwise(F.col("status")).alias("status"))
