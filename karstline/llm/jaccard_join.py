"""N-gram Jaccard self join by grouped prefixes.

A document is the set of its distinct w-word shingles (A-Z lower-cased; with
fewer than w words the whole sequence is its one shingle). Two documents link
when 100 * intersection >= percent * union.

1. Documents with the same set form a class; its smallest id stands for it.
2. A global shingle order, rare first: document counts of shingles, summed over
   all documents in a table of 2**18 cells (its size never grows; shared cells
   only make the order less sharp, never wrong), ties by hash.
3. A set of s shingles has a prefix of s - ceil(percent * s / 100) + 1. Linked
   sets share a shingle of their prefixes. Classes with the same prefix and size
   form one group; only groups are joined, under the size and position filters.
4. Group pairs that pass are expanded to their members. Parities of their shingles
   in 1024 cells differ in no more cells than the sets differ in shingles, which
   rules out most other pairs; the whole sets of the rest are intersected. Members of one group are compared by the same way.

Null, empty and white-space texts have no shingle and link with nothing. A row
with a null id links with nothing and gets a null component. Repeated rows give
as many result rows; rows that repeat an id with other texts are documents of their own.
Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, link_buckets, small_batches, split_by
from .hashing import mix, release, runs, signed, words

CELLS = 1 << 18
BITS = 1024
_U = np.uint64


def shingles(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row, in order."""
    for i, j, w in words(batch, lower=True):
        n = len(w.start)
        at = np.arange(max(0, n - width + 1))
        full = runs(w.hash, at, at + width)
        for row in range(i, j):
            a, b = w.first[row - i], w.first[row - i + 1]
            if b - a >= width:
                yield row, np.unique(full[a : b - width + 1])
            elif b > a:
                yield row, runs(w.hash, np.array([a]), np.array([b]))
            else:
                yield row, np.zeros(0, _U)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offs = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offs[1:])
    flat = signed(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int64()))


def _count_cells(width: int):
    def run(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            if found := [x for _, x in shingles(batch, width)]:
                cells += np.bincount((np.concatenate(found) % _U(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(cells)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["cell", "n"])
        release()

    return run


def _prefixes(width: int, percent: int, weight):
    """doc_id, size, two fingerprints of the set, prefix in the global order."""

    def run(batches):
        cells = weight.value
        for batch in batches:
            size, f1, f2, prefix, odd = [], [], [], [], []
            for _, x in shingles(batch, width):
                s = len(x)
                size.append(s)
                f1.append(np.add.reduce(mix(x)) if s else _U(0))
                f2.append(np.bitwise_xor.reduce(mix(x + _U(0x5851F42D4C957F2D))) if s else _U(0))
                keep = s - (percent * s + 99) // 100 + 1 if s else 0
                parity = np.bincount((mix(x ^ _U(0x2545F4914F6CDD1D)) % _U(BITS)).astype(np.int64), minlength=BITS) & 1
                odd.append(np.packbits(parity.astype(np.uint8)).view(_U))
                order = np.lexsort((x, cells[(x % _U(CELLS)).astype(np.int64)]))[:keep]
                prefix.append(x[order])
            ids, rows = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "row"))
            yield pa.record_batch(
                [ids, rows, pa.array(size, pa.int64()), pa.array(signed(np.array(f1, _U))), pa.array(signed(np.array(f2, _U))), _lists(prefix), _lists(odd)],
                ["doc_id", "row", "size", "f1", "f2", "prefix", "odd"],
            )
        release()

    return run


def _overlap(width: int, percent: int):
    """Pairs (a, b) whose texts x and y meet the threshold."""

    def run(batches):
        for batch in batches:
            hit = []
            for (_, p), (_, q) in zip(_each(batch, "x", width), _each(batch, "y", width)):
                same = len(np.intersect1d(p, q, assume_unique=True))
                hit.append(same > 0 and 100 * same >= percent * (len(p) + len(q) - same))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))
        release()

    return run


def _each(batch: pa.RecordBatch, column: str, width: int):
    return shingles(pa.record_batch([batch.column(batch.schema.get_field_index(column))], ["text"]), width)


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, row, first: one row per row of docs(doc_id, text).

    row: xxhash64 of the text, which tells rows of one id apart. first: whether this document (id and row)
    is the smallest of its component; that of a row which links with nothing is true."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = docs.select("text")

    total = text.mapInArrow(_count_cells(width), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    weight = np.zeros(CELLS, np.int64)
    counts = total.toArrow()  # at most CELLS rows
    weight[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    shared = spark.sparkContext.broadcast(weight)
    keyed = docs.withColumn("row", F.xxhash64("text"))
    kinds = "doc_id long, row long, size long, f1 long, f2 long, prefix array<long>, odd array<long>"
    sets = cut(keyed.mapInArrow(_prefixes(width, percent, shared), kinds), "prefixes")
    shared.destroy()

    # A class is told by its fingerprint f1, which is its vertex; one of its rows stands for its text.
    some = sets.where("size > 0 and doc_id is not null")
    classes = cut(some.groupBy("f1", "f2", "size").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "row")).alias("first")), "classes")
    # 9 of 10 is the least ratio of two different sets that can reach 0.9: below that size only equal sets link.
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    wide = classes.where(f"size >= {least}").select("f1", "f2", "first.doc_id", "first.row")
    members = sets.where(f"size >= {least}").join(wide, ["f1", "f2", "doc_id", "row"], "left_semi").dropDuplicates(["f1", "f2"])
    members = cut(
        members.select(F.col("f1").alias("id"), "doc_id", "row", "size", F.xxhash64("prefix", "size").alias("p1"), F.hash("prefix").alias("p2"), "prefix", "odd"),
        "members",
    )
    groups = cut(members.groupBy("p1", "p2", "size").agg(F.min("id").alias("grp"), F.count("*").alias("n")), "groups")
    member = cut(members.select("id", "p1", "p2", "size").join(groups, ["p1", "p2", "size"]).select("grp", "id", "n"), "member")
    odd = members.select("id", "size", "odd")
    drop_cut(groups)
    apart = lambda x, y: " + ".join(f"bit_count({x}[{k}] ^ {y}[{k}])" for k in range(BITS // 64))
    near = lambda x, y, s, t: f"{100 + percent} * ({apart(x, y)}) <= {100 - percent} * ({s} + {t})"

    def overlapping(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes whose whole sets meet the threshold."""
        both = pairs.join(odd.toDF("a", "s", "p"), "a").join(odd.toDF("b", "t", "q").withColumnRenamed("b", "b_"), F.expr(f"b = b_ and {near('p', 'q', 's', 't')}"))
        pairs = cut(both.select("a", "b"), "near")
        involved = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        place = cut(members.select("id", "doc_id", "row").join(involved, "id"), "involved")
        there = split_by(keyed, "row", place.select("row"))[0].join(place, ["doc_id", "row"])
        texts = cut(there.dropDuplicates(["id"]).select("id", "text"), "texts")
        both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
        found = cut(both.select("a", "b", "x", "y").mapInArrow(_overlap(width, percent), "a long, b long"), "overlaps")
        drop_cut(pairs, place, texts)
        return found

    # Within a group of several members: the members that link form a unit; any other member is a unit of its own.
    several = cut(member.where("n > 1").select(F.col("grp").alias("bucket"), "id"), "several")
    unit = member.select("grp", F.col("id").alias("unit"), "id")
    if not several.isEmpty():
        inside = link_buckets(several, overlapping, sketch=lambda rows: rows.join(odd, "id"), near=near("l.odd", "r.odd", "l.size", "r.size"))
        unit = member.join(inside.withColumnRenamed("v", "id"), "id", "left").select("grp", F.coalesce("root", "id").alias("unit"), "id")
    unit = cut(unit, "units")
    drop_cut(several, member)

    def expanded(pairs: DataFrame) -> DataFrame:
        """Pairs of units of which some members link; members meet only if the parities of their sets allow a link."""
        of = unit.select("unit", "id").join(odd, "id")
        both = pairs.join(of.toDF("x", "a", "s", "p"), "a").alias("l")
        both = both.join(of.toDF("y", "b_", "t", "q").alias("r"), F.expr(f"b = b_ and {near('p', 'q', 's', 't')}"))
        both = cut(both.select("a", "b", F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")), "expanded")
        hit = overlapping(both.select(F.col("hi").alias("a"), F.col("lo").alias("b")).distinct()).toDF("hi", "lo")
        found = cut(both.join(hit, ["hi", "lo"], "left_semi").select("a", "b").distinct(), "joined")
        drop_cut(both)
        return found

    post = members.select(F.col("id").alias("grp"), "size", "prefix").join(unit.select("grp", "unit").distinct(), "grp")
    post = post.select(F.posexplode("prefix").alias("pos", "bucket"), F.col("unit").alias("id"), "size").select("bucket", "id", "size", "pos")
    # At the first shingle that two prefixes share, what is left of either set bounds the intersection.
    keep = (
        f"100 * least(l.size, r.size) >= {percent} * greatest(l.size, r.size) and "
        f"{100 + percent} * least(l.size - l.pos, r.size - r.pos) >= {percent} * (l.size + r.size)"
    )
    # A unit of one member carries its parities; one of several is left to expanded().
    alone = unit.groupBy("unit").agg(F.count("*").alias("n")).where("n = 1").select(F.col("unit").alias("id"))
    sketch = lambda rows: rows.join(alone.join(odd.select("id", "odd"), "id"), "id", "left")
    comp = link_buckets(post, expanded, keep, sketch=sketch, near=f"(l.odd is null or r.odd is null or {near('l.odd', 'r.odd', 'l.size', 'r.size')})")
    root = cut(unit.join(comp.withColumnRenamed("v", "unit"), "unit", "left").select(F.col("id").alias("f1"), F.coalesce("root", "unit").alias("root")), "roots")
    known = cut(classes.join(root, "f1", "left").select("f1", "f2", "size", "rep", "first", F.coalesce("root", "f1").alias("root")), "known")
    low = known.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("first").alias("lead"))
    linked = cut(known.join(low, "root").select("f1", "f2", "size", "component_id", "lead"), "components")
    drop_cut(members, unit, comp, root, known, classes)
    out = sets.select("doc_id", "row", "size", "f1", "f2").join(linked, ["f1", "f2", "size"], "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    lead = F.coalesce((F.col("doc_id") == F.col("lead.doc_id")) & (F.col("row") == F.col("lead.row")), F.lit(True))
    return out.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"), "row", lead.alias("first"))
