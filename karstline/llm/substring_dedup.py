"""Substring dedup by difference-cover anchors.

A word is [^\\x20\\x09-\\x0D]+, unchanged; a window is `length` consecutive words of
one document. Every word covered by a window whose word sequence also starts in a
document with a smaller id goes; windows are judged on the input.

The positions of a document that lie in a difference cover D modulo a period v are
its anchors; each is hashed with the next length - v + 1 words. For any two
positions there is a shift below v that brings both into D, so two equal windows
share an aligned anchor. Anchors held by one document alone, nearly all, end here.
The others are extended: each of the v windows around a shared anchor is
fingerprinted (96 bits) and compared over the documents. Only windows around an
anchor that a larger id shares are offered, and only those around an anchor that
a smaller id has are asked for.

All passages are aggregated by their smallest id before any row is joined, so a
passage in a third of all documents makes one row a document, never a pair.

Null, empty and short texts have no windows and lose nothing. Rows with a null id
keep all their words and take none from others. Rows that repeat an id, with the same or
another text, give a result each: a row is told by id and hash of its text. Windows of the same id
never remove each other. Very long texts are read whole; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, small_batches, split_by
from .hashing import release, runs, signed, words

_U = np.uint64
_SECOND = _U(0xA24BAED4963EE407)


def difference_cover(period: int) -> list[int]:
    """Residues whose differences are all residues modulo period: the smallest set
    with 0 and 1 for periods up to 40, found by trial, beyond them two runs of
    about the square root of the period (0..r-1 and the multiples of r)."""
    if period < 3:
        return list(range(period))
    if period > 40:
        r = math.isqrt(period - 1) + 1
        return sorted({*range(r), *range(0, period, r)})
    for size in range(max(0, math.isqrt(period) - 1), period):
        for rest in itertools.combinations(range(2, period), size):
            chosen = (0, 1, *rest)
            if len({(x - y) % period for x in chosen for y in chosen}) == period:
                return list(chosen)
    return list(range(period))


def _anchors(length: int, period: int):
    if not 1 <= period <= length:
        raise ValueError("period must be from 1 to length")
    cover = np.zeros(period, bool)
    cover[difference_cover(period)] = True
    width = length - period + 1

    def run(batches):
        for batch in batches:
            ids, keys = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
            for i, j, w in words(batch):
                n = np.diff(w.first)
                rows = np.repeat(np.arange(i, j), n)
                pos = np.arange(w.first[0], w.first[-1]) - np.repeat(w.first[:-1], n)
                # an anchor must lie in a whole window of its document
                ok = cover[pos % period] & (pos + width <= np.repeat(n, n)) & (np.repeat(n, n) >= length)
                at = np.flatnonzero(ok) + w.first[0]
                hashes = signed(runs(w.hash, at, at + width))
                own = rows[ok]
                cols = [hashes, ids[own].astype(np.int64), keys[own].astype(np.int64), pos[ok].astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in cols], ["h", "doc_id", "row", "pos"])
        release()

    return run


def _spread(at: np.ndarray, n: int, length: int, period: int) -> np.ndarray:
    """Starts of the windows of a document of n words that hold an anchor at one of these positions."""
    mark = np.zeros(n + 2, np.int32)
    np.add.at(mark, np.maximum(at - period + 1, 0), 1)
    np.add.at(mark, np.minimum(at, n - length) + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: n - length + 1] > 0)


def _windows(length: int, period: int):
    """Windows to offer (kind 0) and to ask for (kind 1) around the shared anchors of a document."""

    def run(batches):
        for batch in batches:
            ids, keys, offer, ask = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "row", "offer", "ask"))
            for i, j, w in words(batch):
                found, owner, key, kinds, place = [np.zeros(0, np.int64)], [], [], [], [np.zeros(0, np.int32)]
                for row in range(i, j):
                    a, n = w.first[row - i], w.first[row - i + 1] - w.first[row - i]
                    for kind, col in enumerate((offer, ask)):
                        if at := col[row].as_py():
                            pos = _spread(np.asarray(at, np.int64), n, length, period)
                            found.append(pos + a)
                            place.append(pos.astype(np.int32))
                            owner.append(np.full(len(pos), ids[row].as_py(), np.int64))
                            key.append(np.full(len(pos), keys[row].as_py(), np.int64))
                            kinds.append(np.full(len(pos), kind, np.int8))
                if owner:
                    s = np.concatenate(found)
                    h1, h2 = runs(w.hash, s, s + length), runs(w.hash, s, s + length, _SECOND)
                    cols = [signed(h1), (signed(h2) >> 32).astype(np.int32), np.concatenate(owner), np.concatenate(key), np.concatenate(place), np.concatenate(kinds)]
                    yield pa.record_batch([pa.array(x) for x in cols], ["h1", "h2", "doc_id", "row", "pos", "kind"])
        release()

    return run


def _kept(length: int):
    """n_words, n_removed and the kept words of each text."""

    def run(batches):
        for batch in batches:
            ids, hit = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "starts"))
            total, gone, text = [], [], []
            for i, j, w in words(batch):
                raw = w.data.tobytes()
                for row in range(i, j):
                    a, b = w.first[row - i], w.first[row - i + 1]
                    keep = np.ones(b - a, bool)
                    if starts := hit[row].as_py():
                        mark = np.zeros(b - a + 1, np.int32)
                        at = np.unique(np.asarray(starts, np.int64))
                        mark[at] += 1
                        np.add.at(mark, at + length, -1)
                        keep = np.cumsum(mark)[:-1] == 0
                    s, e = w.start[a:b][keep], w.end[a:b][keep]
                    total.append(int(b - a))
                    gone.append(int(b - a - len(s)))
                    text.append(b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist())]))
            sha = [hashlib.sha256(x).hexdigest() for x in text]
            yield pa.record_batch(
                [ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array([x.decode() for x in text], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )
        release()

    return run


def repeated_starts(docs: DataFrame, length: int = 50, period: int = 31) -> DataFrame:
    """doc_id, row, starts: the windows of each row of docs(doc_id, row, text) that also start in a document with a smaller id."""
    spark = docs.sparkSession
    small_batches(spark)
    key = ["doc_id", "row"]
    docs = docs.where("doc_id is not null and text is not null").select(*key, "text")
    anchors = docs.mapInArrow(_anchors(length, period), "h long, doc_id long, row long, pos int")
    shared = cut(anchors.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi"), "anchors")
    mine = anchors.join(shared, "h").groupBy(*key).agg(
        F.collect_set(F.when(F.col("hi") > F.col("doc_id"), F.col("pos"))).alias("offer"),
        F.collect_set(F.when(F.col("lo") < F.col("doc_id"), F.col("pos"))).alias("ask"),
    )
    mine = cut(mine, "extend")
    near, _ = split_by(docs, "row", mine.select("row"))
    win = near.join(mine, key).mapInArrow(_windows(length, period), "h1 long, h2 int, doc_id long, row long, pos int, kind byte")
    win = cut(win, "windows")
    first = cut(win.where("kind = 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first")), "offered")
    asked = win.where("kind = 1").select("h1", "h2", *key, "pos").join(first, ["h1", "h2"]).where("first < doc_id")
    starts = cut(asked.groupBy(*key).agg(F.collect_set("pos").alias("starts")), "starts")
    drop_cut(shared, mine, win, first)
    return starts


def substring_dedup(docs: DataFrame, length: int = 50, period: int = 31) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row per row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.col("text").cast("string").alias("text"))
    starts = repeated_starts(docs, length, period)
    hit, rest = split_by(docs, "row", starts.select("row"))
    hit = hit.join(starts, ["doc_id", "row"], "left").select("doc_id", "text", "starts")
    return hit.unionByName(rest.select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"))).mapInArrow(
        _kept(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
