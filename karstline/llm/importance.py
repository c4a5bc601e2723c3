"""Importance resampling towards a target: hashed n-grams, log ratios of their buckets, draws without replacement.

Features of a text are all its runs of 1 to `most` consecutive words (A-Z lower-cased; words are runs of 0-9, a-z and
characters beyond ASCII), joined by one space, each in the bucket crc32 modulo `buckets`. A bucket's gain is the
logarithm (in thousandths, floored) of its smoothed share in the target over that in the corpus; a document's weight the floored mean
of the gains of its features, its score that plus a Gumbel variate that only its id and the seed decide. The highest
scores are drawn: sampling without replacement in proportion to exp(weight).

Counting, per piece of a partition of about `piece` bytes: words become ids, the positions of all texts are sorted into a suffix array (suffixes end with
their text, and are compared up to `most` words: doubling of ranks), and the LCP of neighbours is taken. For
each length n, a run of neighbours with an LCP of n or more holds all occurrences of one n-gram: it is joined and
hashed once, and its bucket is scattered back to the occurrences. No two features are compared by hash alone, words
by 64-bit hashes and lengths. The first pass sums the buckets of corpus and target in tables of at most `buckets` rows, the second
looks gains up for each occurrence and adds them a text. Each text is read whole; pieces are cut between texts.

Documents with at least `least_words` words can be drawn; N of them give floor(percent * N / 100) draws. They are
ranked by ranges of the score (common.ranked): no task sees them all.

A null text has no words; a text without features has weight 0. A null doc_id draws as `<seed>:null` and comes last in ties. Rows that repeat an id are
documents of their own, with one variate. An empty target or corpus leaves the smoothing alone. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, ranked, small_batches
from .hashing import _LOWER, chunks, release, runs, table_of

PIECE = 1 << 21
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, first byte and byte after the last of each word, and the index of each text's first word."""
    data = _LOWER[data]
    word = _WORD[data]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    before[edges], after[edges - 1] = False, False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return data, start, end, np.searchsorted(start, bounds)


def suffixes(ids: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of texts of word ids (a text starts at each of `first`), compared up to `most` words, and the LCP, at most `most`, of each
    suffix with the one before it (0 for the first)."""
    n = len(ids)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words to the end of the text
    rank, have = ids.astype(np.int64), 1
    while have < most:
        # ranks of the next `have` words, 0 where the text has ended: doubles the length that ranks tell apart
        at = np.arange(n) + have
        follow = np.where(left > have, rank[np.minimum(at, n - 1)] + 1, 0)
        _, rank = np.unique(rank * (rank.max(initial=0) + 2) + follow, return_inverse=True)
        have *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n, np.int64)
    same = np.ones(max(n - 1, 0), bool)
    for k in range(most):
        same = same & (left[a] > k) & (left[b] > k)
        same[same] = ids[a[same] + k] == ids[b[same] + k]
        lcp[1:] += same
    return order, lcp


def features(batch: pa.RecordBatch, most: int, buckets: int, piece: int = PIECE):
    """(first row, row after the last, words of each text, texts of the features, their buckets) by pieces."""
    for i, j, data, bounds in chunks(batch, size=piece):
        data, start, end, first = word_bounds(data, bounds)
        n = np.diff(first)
        size = (end - start).astype(np.uint64)
        _, ids = np.unique(runs(table_of(data), start, end) * np.uint64(31) + size, return_inverse=True)
        order, lcp = suffixes(ids, first, most)
        raw = data.tobytes()
        left = np.repeat(first[1:], n) - np.arange(len(ids))
        text = np.repeat(np.arange(j - i), n)
        texts, found = [], []
        for k in range(1, most + 1):
            long = left[order] >= k
            at, head = order[long], lcp[long] < k
            if not len(at):
                break
            # a suffix shorter than k breaks no run: it sorts before all that it is a prefix of
            heads = at[head]
            crc = np.fromiter(
                (zlib.crc32(raw[s:e]) for s, e in zip(start[heads].tolist(), end[heads].tolist())) if k == 1 else
                (zlib.crc32(b" ".join(raw[start[x] : end[x]] for x in range(h, h + k))) for h in heads.tolist()),
                np.int64, len(heads),
            )
            bucket = np.empty(len(ids), np.int64)
            bucket[at] = (crc % buckets)[np.cumsum(head) - 1]
            here = np.flatnonzero(left >= k)
            texts.append(text[here])
            found.append(bucket[here])
        yield i, j, n, np.concatenate(texts) if texts else np.zeros(0, np.int64), np.concatenate(found) if found else np.zeros(0, np.int64)


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """Occurrences of features in each bucket over all of texts(text)."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in features(batch, most, buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])
        release()

    summed = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    got = summed.toArrow()  # at most `buckets` rows
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the corpus) of each bucket."""
    b = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        g = shared.value
        for batch in batches:
            words, counts, weight = [], [], []
            for i, j, n, text, found in features(batch, most, len(g)):
                c = np.bincount(text, minlength=j - i)
                total = np.zeros(j - i, np.int64)
                np.add.at(total, text, g[found])
                words.append(n)
                counts.append(c)
                weight.append(np.where(c > 0, total // np.maximum(c, 1), 0))
            if words:
                rest = [pa.array(np.concatenate(x).astype(np.int64)) for x in (words, counts, weight)]
                yield pa.record_batch([batch.column(batch.schema.get_field_index("doc_id")), *rest], ["doc_id", "n_words", "n_features", "weight"])
        release()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (1 is drawn first; null: not drawn) of every row of docs(doc_id, text).
    target(text) is what the draw should resemble."""
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    gumbel = F.floor(-1000.0 * F.log(-F.log(u))).cast("long")
    scored = cut(weights(docs, gain, most).withColumn("score", F.col("weight") + gumbel), "weights")
    can = scored.where(F.col("n_words") >= least_words)
    n = can.count() * percent // 100
    placed = ranked(can, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc(), number="place")
    rank = F.when(F.col("place") < n, F.col("place") + 1).cast("long")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    out = cut(placed.select(*names, rank.alias("rank")).unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))), "drawn")
    drop_cut(scored, placed)
    return out
