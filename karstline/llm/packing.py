"""Packing into optimal length buckets.

A document's length is its number of words [^\\x20\\x09-\\x0D]+, at least 1. The global
histogram has one row a distinct length, so no more rows than the longest document has
words, whatever the corpus. Dynamic programming over it chooses at most `buckets` upper
bounds that minimise the total padding, bound by bound; the best last cut moves only
forward with the length, so each layer is solved by halving, not by all pairs of lengths.

Within a bucket, documents are ordered by a hash of id and length, and cut into
batches of floor(budget / bound) documents, at least 1, so that a padded batch keeps
within the token budget unless a single document exceeds it. Ranks come in two
steps: each bucket's hash range is cut into chunks of about `chunk` documents that are
ranked alone, and the chunks' counts are summed up before them. No bucket passes
through one task, and all batches but a bucket's last are full.

Null and empty texts count as length 1 (a batch row can't be empty). Rows that are alike in
id and length, null ids included, are counted first and numbered, and the number enters
the hash: a third of all rows with one id spreads like any others. Empty tables give an
empty result. Very long texts are counted whole. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


FAR = 1 << 62
BLOCK = 10_000


def optimal_bounds(top: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds that minimise sum(bound - length) over cells sorted by length.

    top: largest length of a cell, count: its documents, total: their summed length.
    Ties go to fewer buckets, then to the smaller earlier bounds. cost[j] is the least
    padding of the first j cells; a further bucket takes the cells after some i.
    """
    n = len(top)
    if not n:
        return []
    c, t = (np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in (count, total))
    top = np.asarray(top, np.int64)
    cost, choice = top * c[1:] - t[1:], []
    best_k, best = 0, cost[-1]
    for k in range(1, min(buckets, n)):
        new, frm = np.full(n, FAR, np.int64), np.full(n, -1)
        todo = [(k, n - 1, k - 1, n - 2)]  # cells lo..hi whose best i lies in first..last
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)  # the last bucket holds cells i + 1 .. j
            x = cost[i] + top[j] * (c[j + 1] - c[i + 1]) - (t[j + 1] - t[i + 1])
            m = int(np.argmin(x))
            new[j], frm[j] = x[m], i[m]
            todo += [(lo, j - 1, first, int(i[m])), (j + 1, hi, int(i[m]), last)]
        cost = new
        choice.append(frm)
        if cost[-1] < best:
            best_k, best = k, cost[-1]
    bounds, j = [], n - 1
    for k in range(best_k, -1, -1):
        bounds.append(int(top[j]))
        j = int(choice[k - 1][j]) if k else j
    return bounds[::-1]


def pack(docs: DataFrame, budget: int = 8192, buckets: int = 12, chunk: int = 5_000) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_length, batch_id, slot: one row per row of docs(doc_id, text).

    batch_id is unique over buckets: 2**40 * bucket + batch within it.
    """
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))
    n = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.greatest(F.lit(1), F.coalesce(words, F.lit(1))).cast("long").alias("n_tokens"),
    )
    alike = n.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("c"))
    blocks = alike.select("doc_id", "n_tokens", "c", F.explode(F.expr(f"sequence(0L, (c - 1) div {BLOCK})")).alias("b"))
    # a block a row, dealt out again before its rows are numbered, so that no task numbers all of one id
    blocks = blocks.repartition(F.col("doc_id"), F.col("n_tokens"), F.col("b"))
    number = F.explode(F.expr(f"sequence(b * {BLOCK}L, least(c, (b + 1) * {BLOCK}L) - 1)")).alias("i")
    n = blocks.select("doc_id", "n_tokens", number)
    n = cut(n.select("doc_id", "n_tokens", F.xxhash64("doc_id", "n_tokens", "i").alias("h")), "lengths")
    cells = n.groupBy(F.col("n_tokens").alias("top")).agg(F.count("*").alias("n"))
    got = cells.withColumn("t", F.col("n") * F.col("top")).toArrow().sort_by("top")  # a row a distinct length
    bounds = optimal_bounds(*(got[c].to_numpy() for c in ("top", "n", "t")), buckets)
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(i)) for i, b in enumerate(bounds)], F.lit(max(0, len(bounds) - 1)))
    bound = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds or [1]]), F.col("bucket") + 1)
    n = n.withColumn("bucket", bucket)
    size = n.groupBy("bucket").agg(F.count("*").alias("in_bucket"))  # at most `buckets` rows
    place = (F.shiftrightunsigned("h", 33).cast("double") / float(1 << 31) * F.ceil(F.col("in_bucket") / chunk)).cast("long")
    n = n.join(F.broadcast(size), "bucket").withColumn("chunk", place).drop("in_bucket")
    before = n.groupBy("bucket", "chunk").agg(F.count("*").alias("rows"))
    upto = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(before.withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0))).drop("rows"), "chunks")
    own = Window.partitionBy("bucket", "chunk").orderBy(F.shiftrightunsigned("h", 33), "h", "doc_id", "n_tokens")
    ranked = n.withColumn("own", F.row_number().over(own) - 1).join(before, ["bucket", "chunk"])
    ranked = ranked.withColumns({"rank": F.col("own") + F.col("before"), "padded_length": bound})
    ranked = ranked.withColumn("capacity", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_length"))).cast("long"))
    return ranked.select(
        "doc_id", "n_tokens", F.col("bucket").cast("long").alias("bucket"), "padded_length",
        (F.col("bucket").cast("long") * F.lit(1 << 40) + F.expr("rank div capacity")).alias("batch_id"), (F.col("rank") % F.col("capacity")).alias("slot"),
    )
