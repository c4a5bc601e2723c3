"""Quotation linking of conversations, in DataFrame functions only.

Lines are cut by line feeds. A line's quote level is the number of > signs at its
start (blanks between them allowed); level 0 is the message's own. A line such as
"On ... wrote:" right before a quote introduces it and is dropped with it.

Consecutive lines of one level form a passage. Its units are its lines, its sentences
(cut after .!?… and at blank lines, not at line breaks) and its windows of `WINDOW`
words, each normalised (lower case, runs of other than letters and digits to one blank)
and hashed, so a quote is found however it or the original is wrapped; one of less than
WINDOW words is found if it consists of whole lines or sentences. The origin of a quoted unit
is the nearest earlier turn of the conversation whose own text has its hash. Own units come as one row
a conversation, hash and block of 64 turns, with a bit a turn, so a line said in a third of all
messages never meets itself; the turn before a block comes from the blocks before it. A message's parent is
the earlier turn that owns most characters of its lowest-level linked quotes, counted by
lines, sentences or windows, whichever finds most (ties: the later turn); what stands at deeper levels the
parent has quoted itself, so the chain goes on there.
Threads are chains of parents, followed by pointer doubling. A conversation in reply
order is its rows by `position`: threads by the turn they start with, within one by turn, so parents
always come before replies, and messages that quote nothing stay in turn order. Positions are counted by
blocks of turns, whose sizes are summed up before them.

Rows: one per row of conversations, with the formatted message without quotes; a marker <| in
a text gets a blank, so a message can't forge a turn. A null text is empty. Rows with a null conv_id or turn
link with nothing, are their own thread and have no position. Several rows of one turn share its parent and
position. Very long texts are read whole, empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, split_by

MARKS = "^(?:[ \\t]*>)+"
WINDOW = 8
INTRO = "(?i)^\\s*(on .*wrote|am .*schrieb.*|le .*écrit|el .*escribió)\\s*:\\s*$"


def _norm(x: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}]+", " "))


def _passages(conv: DataFrame) -> DataFrame:
    """conv_id, turn, level and lines (without marks) of each run of lines of one level."""
    at = conv.select("conv_id", "turn", F.split("text", "\n").alias("lines"))
    at = at.withColumn("levels", F.transform("lines", lambda x: F.length(F.translate(F.regexp_extract(x, MARKS, 0), " \t", ""))))
    at = at.withColumn("starts", F.expr("filter(sequence(0, size(levels) - 1), i -> i = 0 or levels[i] <> levels[i - 1])"))
    at = at.select("conv_id", "turn", "lines", "levels", "starts", F.posexplode("starts").alias("k", "s"))
    part = F.expr("slice(lines, s + 1, coalesce(get(starts, k + 1), size(levels)) - s)")
    return at.select("conv_id", "turn", F.expr("levels[s]").alias("level"), F.transform(part, lambda x: F.regexp_replace(x, MARKS, "")).alias("lines"))


def _units(passages: DataFrame) -> DataFrame:
    """conv_id, turn, level, kind, h, chars of the lines, sentences and word windows of passages."""
    whole = F.array_join("lines", "\n")
    keys = ["conv_id", "turn", "level"]
    named = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    sentences = F.split(whole, "(?<=[.!?…])\\s+|\\n[ \\t\\r]*\\n")
    parts = F.explode(F.concat(named("line", F.col("lines")), named("sentence", sentences)))
    plain = passages.select(*keys, parts.alias("p")).select(*keys, "p.kind", _norm(F.col("p.x")).alias("norm"))
    plain = plain.where("norm <> ''").select(*keys, "kind", "norm", F.length("norm").cast("double").alias("chars"))
    words = passages.select(*keys, F.split(_norm(whole), " ").alias("words")).where(F.size("words") >= WINDOW)
    words = words.select(*keys, "words", F.explode(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))).alias("i"))
    words = words.select(*keys, F.lit("window").alias("kind"), F.array_join(F.slice("words", F.col("i"), WINDOW), " ").alias("norm"))
    every = plain.unionByName(words.withColumn("chars", F.length("norm") / WINDOW))
    return every.withColumn("h", F.xxhash64("norm")).drop("norm")


def _own_text() -> F.Column:
    """Level-0 lines of text, without introductions of quotes, joined again."""
    lines = F.split("text", "\n")
    quoted = f"rlike(x, {_q(MARKS)})"
    intro = f"(rlike(x, {_q(INTRO)}) and coalesce(rlike(get(lines, i + 1), {_q(MARKS)}), false))"
    return lines, F.expr(f"array_join(filter(lines, (x, i) -> not {quoted} and not {intro}), '\\n')")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _origins(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """quoted with origin, the last turn before it whose own units have the hash; quotes without one are left out."""
    block, bit = F.floor(F.col("turn") / 64), F.pmod(F.col("turn"), F.lit(64)).cast("int")
    said = own.groupBy("conv_id", "h", block.alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(turn, 64) as int))")).alias("bits"), F.max("turn").alias("last"))
    asked = quoted.withColumns({"block": block, "bit": bit})
    known = asked.select("conv_id", "h", "block").distinct()
    # only what is quoted in the conversation matters; a block without a saying still needs the one before it
    said = said.join(known.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")
    every = said.unionByName(known.select("conv_id", "h", "block", F.lit(0).cast("long").alias("bits"), F.lit(None).cast("long").alias("last")))
    every = every.groupBy("conv_id", "h", "block").agg(F.bit_or("bits").alias("bits"), F.max("last").alias("last"))
    before = Window.partitionBy("conv_id", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("before", F.last("last", ignorenulls=True).over(before)).drop("last")
    got = asked.join(every, ["conv_id", "h", "block"])
    earlier = F.expr("bits & ~shiftleft(-1L, bit)")
    origin = F.when(earlier != 0, F.col("block") * 64 + F.length(F.bin(earlier)) - 1).otherwise(F.col("before"))
    return got.withColumn("origin", origin).where("origin is not null").drop("block", "bit", "bits", "before")


def _positions(rows: DataFrame, block: int = 1024) -> DataFrame:
    """conv_id, thread, turn, position of rows(conv_id, turn, thread): places in the order of thread, then turn."""
    one = rows.where("conv_id is not null and turn is not null").select("conv_id", "thread", "turn").distinct()
    one = one.withColumn("block", F.floor(F.col("turn") / block))
    size = one.groupBy("conv_id", "thread", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("thread", "block").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select("conv_id", "thread", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "thread", "block").orderBy("turn"))
    return one.withColumn("own", inside).join(size, ["conv_id", "thread", "block"]).select("conv_id", "thread", "turn", (F.col("before") + F.col("own") - 1).alias("position"))


def quote_links(conv: DataFrame) -> DataFrame:
    """conv_id, turn, parent, thread, depth of every turn that quotes an earlier one."""
    known = conv.where("conv_id is not null and turn is not null and text is not null")
    some = known.where(F.col("text").rlike("(?m)" + MARKS))
    quoted = cut(_units(_passages(some).where("level > 0")), "quotes")
    # Conversations without quotes need no own units.
    own = split_by(known, "conv_id", quoted.select("conv_id"))[0]
    hit = cut(_origins(quoted, _units(_passages(own).where("level = 0"))), "origins")
    votes = hit.groupBy("conv_id", "turn", "level", "origin", "kind").agg(F.sum("chars").alias("chars"))
    votes = votes.groupBy("conv_id", "turn", "level", "origin").agg(F.max("chars").alias("chars"))
    best = F.min(F.struct("level", (-F.col("chars")).alias("less"), (-F.col("origin")).alias("late")))
    links = votes.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", (-F.col("b.late")).alias("parent"))
    links = cut(links, "links")
    state = cut(links.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved")), "chains")
    while not state.where("moved").isEmpty():
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        new = cut(
            state.join(above, ["conv_id", "up"], "left").select(
                "conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("up2").isNotNull().alias("moved"),
            ),
            "chains",
        )
        drop_cut(state)
        state = new
    return links.join(state.select("conv_id", "turn", F.col("up").alias("thread"), "depth"), ["conv_id", "turn"])


def reply_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent, thread, depth, position, n_quoted, message."""
    conv = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    links = cut(quote_links(conv), "replies")
    lines, own = _own_text()
    n = F.expr(f"cast(size(filter(lines, x -> rlike(x, {_q(MARKS)}))) as long)")
    shown = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.replace(F.trim("own"), F.lit("<|"), F.lit("< |")), F.lit("<|end|>"))
    out = conv.withColumn("lines", lines).withColumns({"own": own, "n_quoted": n}).join(links, ["conv_id", "turn"], "left")
    out = out.withColumn("thread", F.coalesce("thread", "turn"))
    turns = conv.select("conv_id", "turn").join(links.select("conv_id", "turn", "thread"), ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    out = out.join(_positions(turns), ["conv_id", "thread", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "parent", "thread",
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "position", "n_quoted", shown.alias("message"),
    )
