"""Prefix trie of conversations, with subtree totals by peeling leaves.

A node at depth d is a distinct sequence of first d turns (role and text); its members are the conversations that
start with it. A prefix is told by two 64-bit sums (exclusive or) of hashes of place and turn. Such sums
can be taken block by block, so a conversation that holds a third of all turns is cut into blocks of `BLOCK` turns like
any other, and nodes come from one aggregation of (depth, prefix), which is combined before the shuffle.

Totals over subtrees come by messages from the leaves up. Each node belongs to one chain: that of the member whose hashed id is least.
A node's chain is also that of the child this member goes on to, so a chain runs down to the end of its
conversation, and each other child is the head of a chain of its own. Chains hold a counter of such children that have not yet
reported. A chain whose counter is at zero is complete, since all its nodes now only wait for the next one down the
chain: it sends its totals (leaves, saved tokens) to the parent of its head, whose chain counts one child less. Rounds go on until only
the root's chain is left and completes. Hashes make the least member of a set a random one, so on a way from the root to a leaf chains
change about ln(n) times, as often as a random order has new records: rounds are few, whatever the shape, also for one
conversation with thousands of turns, or for thousands that each leave the same one a turn later. In the end each node adds what its light children sent, and
sums run up each chain, again by blocks.

The digest of the conversations that end at a node needs their ids in order: they are joined to pieces of `PIECE` ids
at most, which one pass in order feeds to a running hash; no list of all members exists anywhere.

Turns are ordered by turn (null first), then by hashes of role and text; turns equal in all of that are turns of their own. Null roles and texts
are empty. Rows without a conv_id are left out. An empty table gives no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, ranked, small_batches

BLOCK = 1024
PIECE = 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def running(df: DataFrame, key: str, at: str, xor: tuple = (), add: tuple = (), up: bool = False) -> DataFrame:
    """df with the columns xor and add turned into running totals of each key in the order of `at` (a number from 0; up: from its end). Blocks of
    BLOCK places are summed apart, and the totals of the blocks before are added; only keys with several blocks have any."""
    part = F.expr(f"`{at}` div {BLOCK}")
    order = F.col(at).desc() if up else F.col(at)
    inside = Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(F.col("__b").desc() if up else F.col("__b")).rowsBetween(Window.unboundedPreceding, -1)
    take = [(c, F.bit_xor) for c in xor] + [(c, F.sum) for c in add]
    df = df.withColumn("__b", part)
    sums = df.groupBy(key, "__b").agg(*[f(c).alias(c) for c, f in take])
    several = df.where("__b > 0").select(key).distinct()
    offs = sums.join(several, key, "left_semi").select(key, "__b", *[f(c).over(before).alias(f"__{c}") for c, f in take])
    out = df.select(*[c for c in df.columns if c not in {c for c, _ in take}], *[f(c).over(inside).alias(c) for c, f in take]).join(offs, [key, "__b"], "left")
    whole = {c: F.col(c).bitwiseXOR(F.coalesce(f"__{c}", F.lit(0).cast("long"))) for c in xor} | {c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in add}
    return out.withColumns(whole).drop("__b", *[f"__{c}" for c, _ in take])


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, g1, g2, words, last of every turn; conv_id, length of every conversation)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("g1"), F.xxhash64(F.lit(7), text, role).alias("g2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = ranked(slim, "conv_id", "turn", "g1", "g2")
    convs = cut(order.groupBy("conv_id").agg(F.min("rank").alias("start"), F.count("*").alias("length")), "conversations")
    turns = order.join(convs, "conv_id").withColumn("depth", F.col("rank") - F.col("start") + 1)
    turns = cut(turns.select("conv_id", "depth", "g1", "g2", "words", (F.col("depth") == F.col("length")).alias("last")), "turns")
    drop_cut(order)
    return turns, convs.select("conv_id", "length")


def shared_heads(turns: DataFrame, convs: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """The same tables after each conversation c has given its first h turns for those of conversation c - c % group (all if that has
    fewer, none if it is absent); h is the crc32 of c as text, modulo `heads`."""
    own = convs.withColumns({"base": F.expr(f"conv_id - conv_id % {group}"), "h": F.expr(f"crc32(cast(conv_id as string)) % {heads}")})
    lead = convs.select(F.col("conv_id").alias("base"), F.col("length").alias("there"))
    own = own.join(lead, "base", "left").withColumn("given", F.least("h", F.coalesce("there", F.lit(0))))
    own = cut(own.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")), "heads")
    first = turns.where(f"conv_id % {group} = 0 and depth < {heads}").withColumnRenamed("conv_id", "base")  # less than `heads` turns a base, for less than `group` conversations
    start = own.where("given > 0").join(first, "base").where("depth <= given")
    rest = turns.join(own, "conv_id").where("depth > h").withColumn("depth", F.expr("given + depth - h"))
    names = ["conv_id", "depth", "g1", "g2", "words"]
    last = (F.col("depth") == F.col("length")).alias("last")
    return start.select(*names, last).unionByName(rest.select(*names, last)), own.select("conv_id", "length")


def peel(chains: DataFrame) -> DataFrame:
    """chains(rep, up, at, waiting, leaves, saved) with their totals complete: each round, chains that wait for no child report to `up`."""
    wait, done = cut(chains, "chains"), []
    while True:
        ready = wait.where("waiting = 0")
        done.append(ready)
        sent = ready.where("up is not null").groupBy(F.col("up").alias("rep")).agg(F.count("*").alias("__n"), F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved"))
        rest = wait.where("waiting > 0").join(sent, "rep", "left")
        less = {c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in ("leaves", "saved")} | {"waiting": F.col("waiting") - F.coalesce("__n", F.lit(0))}
        wait = cut(rest.withColumns(less).select(*chains.columns), "chains")
        if wait.isEmpty():
            drop_cut(wait)
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def digests(ends: DataFrame) -> DataFrame:
    """depth, p1, p2, ends_sha256 over ends(depth, p1, p2, conv_id): SHA-256 of the ids in ascending order, joined by commas."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    key = ["depth", "p1", "p2"]
    pieces = ends.groupBy(*key, F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(ids.alias("ids"))
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        now, state = None, None
        for b in batches:
            keys = zip(*[b.column(i).to_pylist() for i in range(3)])
            out = []
            for k, ids in zip(keys, b.column(3)):
                if k != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield of(out)
        if now:
            yield of([(*now, state.hexdigest())])

    def of(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [*key, "ends_sha256"])

    ordered = pieces.repartition(n, *key).sortWithinPartitions(*key, "piece").select(*key, "ids")
    return ordered.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node.

    conv_id is the node's smallest member, which with the depth tells nodes apart; saved_tokens sums, over the subtree, the words of each node's last turn
    times its members but one."""
    small_batches(turns.sparkSession)
    marked = turns.withColumns({"a1": F.xxhash64("depth", "g1", "g2"), "a2": F.xxhash64(F.lit(1), "g2", "g1", "depth")}).drop("g1", "g2")
    members = running(marked.withColumns({"p1": F.col("a1"), "p2": F.col("a2")}), "conv_id", "depth", xor=("p1", "p2"))
    names = ["conv_id", "depth", "p1", "p2", "words", "last"]
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("words"), (F.col("length") == 0).alias("last"))
    members = members.select(*names, F.col("p1").bitwiseXOR(F.col("a1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("a2")).alias("q2"))
    none = F.lit(None).cast("long")
    members = cut(members.unionByName(root.withColumns({"q1": none, "q2": none})), "members")
    # xxhash64 of one long is a bijection, so the least hash names the member
    nodes = members.groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(F.xxhash64("conv_id")).alias("rep"),
        F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
    )
    nodes = cut(nodes, "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("rep").alias("parent_rep"))
    nodes_up = cut(nodes.join(above, ["depth", "q1", "q2"], "left").drop("q1", "q2"), "linked")
    light = F.col("rep") != F.col("parent_rep")
    children = nodes_up.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"), F.count_if(light).alias("waiting")
    )
    own = nodes_up.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children", "waiting"])
    own = own.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    own = cut(own, "own")
    chains = own.groupBy("rep").agg(
        F.max(F.when(light, F.col("parent_rep"))).alias("up"), (F.min("depth") - 1).alias("at"),
        F.sum("waiting").alias("waiting"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
    )
    sent = peel(chains).where("up is not null").groupBy(F.col("up").alias("rep"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved"))
    own = own.join(sent, ["rep", "depth"], "left")
    own = own.withColumns({c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in ("leaves", "saved")})
    total = running(own.select("rep", "depth", "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_children", "leaves", "saved"), "rep", "depth", add=("leaves", "saved"), up=True)
    ends = digests(members.where("last").select("depth", "p1", "p2", "conv_id"))
    out = total.join(ends, ["depth", "p1", "p2"], "left")
    out = cut(out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    ), "trie")
    drop_cut(members, nodes, nodes_up)
    return out


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text) as they are."""
    return trie(*numbered(conversations))
