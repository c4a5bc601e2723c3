"""op12: suffix arrays against sorting, weights and draws against a plain reading, odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from karstline.llm import importance, queries

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def grams(t, most):
    w = words(t)
    return [" ".join(w[i : i + k]).encode() for k in range(1, most + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("most", [1, 2, 3, 5, 8])
def test_suffixes(most):
    rng = np.random.default_rng(most)
    texts = [rng.integers(0, 3, n).tolist() for n in (0, 1, 2, 7, 30, 30, 0)] + [[1] * 20, [1] * 20]
    ids, first = np.array(sum(texts, []), np.int64), np.cumsum([0, *map(len, texts)])
    order, lcp = importance.suffixes(ids, first, most)
    tail = [tuple(t[i : i + most]) for t in texts for i in range(len(t))]
    assert [tail[i] for i in order] == sorted(tail)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0] + [common(tail[a], tail[b]) for a, b in zip(order, order[1:])]


@pytest.mark.parametrize("most,piece", [(1, 1 << 21), (2, 50), (3, 1 << 21), (4, 300)])
def test_buckets(most, piece):
    texts = ["A b c a B c", None, "", "-- !", "é_x a-b 9", "a " * 50, "a b c a b c", "İstanbul Ñ " * 5, "one"]
    got = collections.Counter()
    for i, j, n, text, found in importance.features(pa.record_batch([pa.array(texts)], ["text"]), most, 10_000, piece):
        assert n.tolist() == [len(words(t)) for t in texts[i:j]]
        got.update(zip((text + i).tolist(), found.tolist()))
    assert got == collections.Counter((i, zlib.crc32(g) % 10_000) for i, t in enumerate(texts) for g in grams(t, most))


def plain(docs, target, most, buckets, least, percent):
    s, t = (collections.Counter(zlib.crc32(g) % buckets for x in xs for g in grams(x, most)) for xs in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, x in docs:
        g = [gain(zlib.crc32(f) % buckets) for f in grams(x, most)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(words(x)), len(g), weight, score))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2]))
    n = len(order) * percent // 100
    out = collections.Counter((*r, k + 1 if k < n else None) for k, r in enumerate(order))
    out.update((*r, None) for r in rows if r[1] < least)
    return out


ODD = [(900001, None), (900002, ""), (900003, "-- !!"), (None, "no id " * 30), (None, "no id " * 30), (900004, "Long word " * 40_000), (900005, "é" * 3000), (900006, "twice " * 25), (900006, "twice " * 25), (900006, "other text " * 25)]


@pytest.mark.parametrize("most,buckets,percent", [(1, 10_000, 10), (3, 500, 40), (2, 7, 100)])
def test_resample(spark, most, buckets, percent):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    target = spark.read.parquet(f"{D}/benchmark.parquet")
    wide = docs.withColumns({"score": F.lit("x"), "rank": F.lit(1), "weight": F.lit(2), "place": F.lit(3)})
    got = importance.resample(wide, target, most, buckets, percent=percent).collect()
    want = plain([tuple(r) for r in docs.collect()], [r.text for r in target.collect()], most, buckets, 20, percent)
    assert collections.Counter(tuple(r) for r in got) == want


def test_odd_tables(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} " * 30) for i in range(50)], "doc_id long, text string")
    nothing = spark.createDataFrame([], "text string")
    got = importance.resample(docs, nothing).collect()
    assert collections.Counter(tuple(r) for r in got) == plain([(r.doc_id, f"word{r.doc_id % 3} " * 30) for r in got], [], 1, 10_000, 20, 10)
    assert importance.resample(docs.limit(0), nothing).collect() == []
    assert importance.resample(docs.limit(0), docs).collect() == []


def test_draw_nears_the_target(spark):
    """Of two kinds of documents in equal parts, the draw takes mostly the kind that the target is made of."""
    rng = np.random.default_rng(0)
    text = lambda k: " ".join(f"{'xy'[k]}{v}" for v in rng.integers(0, 50, 40))
    docs = spark.createDataFrame([(i, text(i % 2)) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(text(1),) for _ in range(40)], "text string")
    drawn = [r.doc_id for r in importance.resample(docs, target).collect() if r.rank]
    assert len(drawn) == 40 and sum(i % 2 for i in drawn) >= 38


def test_query(spark):
    assert oracle.compare(spark, queries.QUERIES["op12_importance_resampling"], queries.ORACLE["op12_importance_resampling"], D) > 0
