"""Shared helpers: written cut points, distributed components, bucket linking."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the
    context's checkpoint folder. In local mode, where all is one machine, a folder of
    our own is made where neither is set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="karstline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def cut(df: DataFrame, name: str = "cut", compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends
    there, a lost executor costs nothing that was finished, and the shuffle
    files of the writing query are freed when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*frames: DataFrame | None) -> None:
    """Delete written cut points that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ranked(df: DataFrame, *order: Column | str, number: str = "rank") -> DataFrame:
    """df, written, with the place of each row (from 0) in this order over all rows.

    Ranges of the order are sorted apart, and the counts of the ranges before (a row a range) are added, so no task
    sees all rows. Rows that are equal in all of order lie in one range: give it columns that tell rows apart."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = own.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    out = out.withColumn(number, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__before")
    out._cut_path = own._cut_path
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows a record batch sent to Python: long texts make the default of 10,000
    rows too large for an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (v, root), root the smallest
    vertex reachable from v, for every vertex of an edge between two vertices.

    Distributed union-find by alternating large-star and small-star rounds until
    all edges lead to a root. Minimum labels are pre-aggregated before each
    shuffle, written, and joined back, so that a vertex with a third of all edges
    is split by adaptive execution. Self loops and edges with nulls are ignored.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(e):
        both = e.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(
            e.select(F.col("v").alias("n"), F.col("u").alias("x"))
        )
        low = cut(both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m")), "low")
        large = cut(both.where("x > n").join(low, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        hang = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(hang.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_cut(e, low, large, least)
        e = new
    roots = e.select(F.col("v").alias("v"), F.col("v").alias("root")).distinct()
    out = e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(roots)
    out._cut_path = e._cut_path
    return out


def _settled(e: DataFrame) -> bool:
    """Whether edges (u, v) are stars: no vertex has two edges up, and none stands on both sides."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return odd.where("up > 1 or (up > 0 and down > 0)").isEmpty()


BITS = 1 << 23


def marked(keys: DataFrame) -> DataFrame:
    """A bit table of keys (one column, any type): at most BITS / 64 rows, whatever the number of keys."""
    bit = _BIT.format(keys.columns[0])
    word = keys.select(F.expr(f"shiftright({bit}, 6)").alias("__word"), F.expr(f"shiftleft(1L, cast({bit} % 64 as int))").alias("b"))
    return word.groupBy("__word").agg(F.bit_or("b").alias("__mask"))


_BIT = f"pmod(xxhash64(`{{}}`), {BITS}L)"


def split_by(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key may be in keys, all others), told apart by the bit table without a
    shuffle of df. The first part holds some rows besides; more, up to all, as the table fills."""
    bits = cut(marked(keys), "bits")
    bit = _BIT.format(key)
    known = df.withColumn("__word", F.expr(f"shiftright({bit}, 6)")).join(F.broadcast(bits), "__word", "left")
    hit = F.expr(f"coalesce(shiftright(__mask, cast({bit} % 64 as int)) & 1, 0) = 1")
    return known.where(hit).drop("__word", "__mask"), known.where(~hit).drop("__word", "__mask")


def only(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Left semi join of df with keys (key), after split_by has put most other rows aside."""
    return split_by(df, key, keys)[0].join(keys, key, "left_semi")


def link_buckets(
    post: DataFrame | list[DataFrame | Callable[[], DataFrame]], verify: Callable[[DataFrame], DataFrame], keep: str = "true", rounds: int = 3,
    prepare: Callable[[DataFrame], DataFrame | None] | None = None, sketch: Callable[[DataFrame], DataFrame] | None = None, near: str = "true", tag: str | None = None,
) -> DataFrame:
    """Components over all verified pairs of post(bucket, id, ...) that share a bucket. post may come in parts
    that have no bucket in common; they are looked through one after another, to hold fewer shuffle files at a time. A part may be a function
    that makes it when its turn comes; if that is a cut point, it is deleted after.

    Emitting every pair within a bucket grows with its square, so each of `rounds` rounds
    takes one hub out of every open bucket, compares it with all members of other
    components, and puts it aside: all its pairs there are done. The hub is the member
    that lies in most shared buckets, which an original among its variants does. A bucket is
    open while its other members lie in several components; further links inside one
    component could not change it. Of buckets still open after that, members of different
    components meet in one join whose condition holds the exact test `near` of the
    columns that `sketch` adds, so only pairs that can link become rows. No bucket is
    capped and no link that matters for the components is lost.

    keep: predicate on columns of post as l.* and r.* that every linkable pair
    meets (size or position filter). verify: takes distinct pairs (a, b) and
    returns those that link. prepare: called once, with the rows of post that share
    a bucket; every later pair is of their ids. It may return these rows with further columns for keep to use. sketch: adds columns to rows of post;
    near: predicate on them that every linkable pair meets. tag: expression of l and r that pairs carry to verify
    as a third column, such as the kind of bucket that they met in. Returns (v, root) of linked vertices.
    """
    parts = []
    for p in post if isinstance(post, list) else [post]:
        made_here = callable(p)
        p = p() if made_here else p
        multi = cut(p.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket"), "multi")
        parts.append(cut(only(p, "bucket", multi).distinct(), "live"))
        drop_cut(multi)
        if made_here:
            drop_cut(p)
    live = functools.reduce(DataFrame.unionByName, parts)
    rows = prepare(live) if prepare else None
    degree = cut(live.groupBy("id").agg(F.count("*").alias("degree")), "degree")
    live = live if rows is None else rows
    lab = cut(live.join(degree, "id").withColumn("lab", F.col("id")), "labelled")
    drop_cut(*parts, degree)
    names = live.columns
    cols, comp = [F.col(c) for c in names], None
    for k in range(rounds + 1):
        if comp is not None:
            left = lab.drop("lab").join(hub.select("bucket", F.col("hub.id").alias("id")), ["bucket", "id"], "left_anti")
            left = left.join(comp.withColumnRenamed("v", "id"), "id", "left").withColumn("lab", F.coalesce("root", "id")).drop("root")
            left = cut(left, "labelled")
            open_ = cut(left.groupBy("bucket").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo < hi").select("bucket"), "open")
            drop_cut(lab, hub)
            if open_.isEmpty():
                drop_cut(left, open_)
                break
            lab = cut(left.join(open_, "bucket"), "labelled")
            drop_cut(left, open_)
        if k < rounds:
            best = F.max(F.struct("degree", (-F.col("id")).alias("low"), "lab", *cols))
            hub = cut(lab.groupBy("bucket").agg(best.alias("hub")), "hub")
            pairs = lab.alias("l").join(hub.select("bucket", "hub.lab", *[F.col(f"hub.{c}") for c in names if c != "bucket"]).alias("r"), F.expr(f"l.bucket = r.bucket and l.lab <> r.lab and ({keep})"))
        else:
            rich = cut(sketch(lab), "rich") if sketch else lab
            pairs = rich.alias("l").join(rich.alias("r"), F.expr(f"l.bucket = r.bucket and l.id < r.id and l.lab <> r.lab and ({keep}) and ({near})"))
        ends = [F.greatest("l.id", "r.id").alias("a"), F.least("l.id", "r.id").alias("b"), *[F.expr(tag).alias("tag")] * bool(tag)]
        pairs = cut(pairs.select(*ends).distinct(), "pairs")
        found = cut(verify(pairs).select("a", "b"), "links")
        links = found if comp is None else comp.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(found)
        old, comp = comp, components(links)
        drop_cut(pairs, found, old)
        if k == rounds:
            drop_cut(lab, *[rich] * (rich is not lab))
    return comp
