"""Clock domains: offsets along recorded links, to the platform's time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import forget, written


def _runs(hops: DataFrame, ends: DataFrame) -> DataFrame:
    """node, nxt, end, n, way: for each link from node to its neighbour nxt, the first of `ends` that is met when one goes on from there without turning, after n links; `way` is what is
    to be added to end's offset on the way back. Where no end is met there is no row.

    hops(frm, to, step), one row a pair; a domain that isn't an end has two neighbours, so there is one way on. Each round doubles the stretches, so rounds grow with the logarithm of the longest run."""
    stop = ends.select(F.col("domain").alias("to"), F.lit(True).alias("__stop"))
    back = hops.select(F.col("frm").alias("node"), F.col("to").alias("nxt"), F.col("frm").alias("last"), F.col("to").alias("at")).join(hops.select(F.col("frm").alias("nxt"), F.col("to").alias("node"), F.col("step").alias("way")), ["node", "nxt"])
    part = written(back.join(stop.withColumnRenamed("to", "at"), "at", "left").select("node", "nxt", "last", "at", F.lit(1).cast("long").alias("n"), "way", F.col("__stop").isNotNull().alias("done")))
    ways = hops.select(F.col("frm").alias("at"), F.col("to").alias("on"))
    finished = part.where("done").count()
    while True:
        # the stretch that goes on where this one ends, away from where it came
        more = part.select(F.col("node").alias("at"), F.col("nxt").alias("on"), F.col("last").alias("last2"), F.col("at").alias("at2"), F.col("n").alias("n2"), F.col("way").alias("way2"), F.col("done").alias("done2"))
        going = part.where("not done").join(ways, "at").where("on <> last").join(more, ["at", "on"])
        going = going.select("node", "nxt", F.col("last2").alias("last"), F.col("at2").alias("at"), (F.col("n") + F.col("n2")).alias("n"), (F.col("way") + F.col("way2")).alias("way"), F.col("done2").alias("done"))
        longer = written(part.where("done").unionByName(going))
        forget(part)
        part, before = longer, finished
        finished = part.where("done").count()
        if finished == before:  # what is left goes round in rings without an end
            out = written(part.where("done").select("node", "nxt", F.col("at").alias("end"), "n", "way"))
            forget(part)
            return out


def resolve_clocks(domains: DataFrame, links: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """domain, root, offset_ns, error of domains(domain, is_platform): what is to be added to a domain's time to get the time of the platform domain it reaches.

    links(a, b, offset_ns): time of b = time of a + offset_ns; they hold both ways. Of several chains the one with the fewest links counts, of these the one by the smallest
    root, then neighbour, then offset. Rows of domains with two neighbours each are taken as one stretch; what stands between stretches (platform domains, ends, forks) is then resolved from its
    neighbours' state of the round before, until nothing changes: as many rounds as the longest chain has forks. error: 'unresolvable' if no chain leads to a platform domain; 'contradictory' for all domains that share
    a root with a link on which the offsets of its two ends do not agree, a self link of other than 0 included, or that joins two roots whose times differ there. Links with a null, or to a domain
    that is not listed, are not there. Nothing is guessed: offset_ns is null with an error."""
    known = domains.where("domain is not null").groupBy("domain").agg(F.max(F.coalesce("is_platform", F.lit(False))).alias("is_platform"))
    ends = known.select("domain")
    good = links.where("a is not null and b is not null and offset_ns is not null").join(ends.toDF("a"), "a", "left_semi").join(ends.toDF("b"), "b", "left_semi")
    good = good.select("a", "b", "offset_ns").distinct()
    # leaving along a link: to a's time one goes from b by taking the offset off; the carried offset is to the root. Of links between the same two the least step counts
    both = good.where("a <> b").select(F.col("a").alias("frm"), F.col("b").alias("to"), (-F.col("offset_ns")).alias("step")).unionByName(good.where("a <> b").select(F.col("b").alias("frm"), F.col("a").alias("to"), F.col("offset_ns").alias("step")))
    both = written(both.groupBy("frm", "to").agg(F.min("step").alias("step")))
    within = both.groupBy(F.col("frm").alias("domain")).agg(F.count("*").alias("__n"))
    marks = written(known.join(within, "domain", "left").select("domain", "is_platform", (F.col("is_platform") | (F.coalesce("__n", F.lit(0)) != 2)).alias("stop")))
    runs = _runs(both, marks.where("stop").select("domain"))
    platform = marks.where("is_platform").select("domain", F.lit(0).cast("long").alias("n"), F.col("domain").alias("root"), F.lit(0).cast("long").alias("offset_ns"))

    def reached(rows: DataFrame, state: DataFrame) -> DataFrame:
        r = rows.join(state.select(F.col("domain").alias("end"), F.col("n").alias("__n"), "root", "offset_ns"), "end")
        best = r.groupBy("node").agg(F.min(F.struct((F.col("n") + F.col("__n")).alias("n"), "root", "nxt", (F.col("offset_ns") + F.col("way")).alias("offset_ns"))).alias("b"))
        return best.select(F.col("node").alias("domain"), "b.n", "b.root", "b.offset_ns")

    forks = marks.where("stop and not is_platform").select(F.col("domain").alias("node"))
    between, inner = runs.join(forks, "node", "left_semi"), marks.where("not stop").select(F.col("domain").alias("node"))
    state = written(platform)
    for _ in range(most_rounds):
        nxt = written(platform.unionByName(reached(between, state)))
        same = nxt.join(state, nxt.columns, "left_anti").isEmpty()
        forget(state)
        state = nxt
        if same:
            break
    else:
        raise ValueError("too many rounds")
    seen = written(state.unionByName(reached(runs.join(inner, "node", "left_semi"), state)).select("domain", "root", "offset_ns"))
    for done in (state, runs):
        forget(done)
    at = lambda side: seen.select(F.col("domain").alias(side), F.col("root").alias(f"root_{side}"), F.col("offset_ns").alias(f"at_{side}"))
    # a's time and b's own must name the same moment of the root's time
    odd = good.join(at("a"), "a").join(at("b"), "b").where("at_a <> at_b + offset_ns")
    roots = written(odd.select(F.explode(F.array("root_a", "root_b")).alias("root")).distinct())
    forget(both)
    forget(marks)
    out = known.select("domain").join(seen, "domain", "left").join(roots.withColumn("__odd", F.lit(True)), "root", "left")
    error = F.when(F.col("root").isNull(), "unresolvable").when(F.col("__odd"), "contradictory")
    return out.select("domain", "root", F.when(error.isNull(), F.col("offset_ns")).alias("offset_ns"), error.alias("error"))


def to_platform(readings: DataFrame, resolved: DataFrame, domain: str, ts: str) -> DataFrame:
    """readings with platform_ns and clock_error: a reading whose domain has an error, or is unknown, has no platform time."""
    r = resolved.select(F.col("domain").alias("__d"), F.col("offset_ns").alias("__o"), F.col("error").alias("__e"))
    out = readings.join(r, F.col(domain) == F.col("__d"), "left")
    error = F.when(F.col("__d").isNull(), "unresolvable").otherwise(F.col("__e"))
    return out.withColumns({"platform_ns": F.col(ts) + F.col("__o"), "clock_error": error}).drop("__d", "__o", "__e")
