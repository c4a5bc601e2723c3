"""Corpus operators against brute force, round trips and odd inputs."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from karstline.llm import bpe_duckdb, cap_neardup, jaccard_join, line_dedup, ogg_media, packing, pii, quality_knn, quote_chat, substring_dedup
from karstline.llm.common import components, link_buckets

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, "a b c d"), (900001, None), (900002, ""), (900003, " \t\n"), (900004, "x " * 30000), (900005, "y" * 5000), (900006, "one two three"), (900006, "one two three"), (900007, "é😀 " * 60)]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    return base.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def union_find():
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)

    return find, join


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_op1(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 16))
    near = x[:40] + 0.02 * rng.standard_normal((40, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(np.concatenate([x, near, near[:5]]))]
    rows = [(i, v, (i - 60) % 3 if 60 <= i < 100 else k) for i, v, k in rows]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, x[0].tolist(), None), (None, x[0].tolist(), 0), (504, [], 1), rows[0]]
    got = {r.vec_id: r for r in cap_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    ok = {i: (np.array(v) / np.linalg.norm(v), k) for i, v, k in rows if i is not None and i < 500}
    find, join = union_find()
    n = collections.Counter()
    for a in ok:
        for b in ok:
            if a != b and ok[a][1] == ok[b][1] and ok[a][0] @ ok[b][0] >= 0.98:
                n[a] += 1
                join(a, b)
    for i in ok:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], find(i), find(i) == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 505)) and got[None].component_id is None


@pytest.mark.parametrize("block", [1, 2, 3])
def test_op1_small_blocks(spark, block):
    """40 vectors that all link, in blocks some of which are empty; components near the ends of the doubles."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    rows = [(i, ((base + 0.01 * rng.standard_normal(16)) * (1e160 if i % 2 else 1e-160)).tolist(), 1) for i in range(40)]
    got = cap_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=block).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 39, 0) for i in range(40)}


def test_op1_uneven_energy(spark):
    """Pairs at a cosine just over 0.98 whose energy is spread unevenly over the dimensions."""
    rng = np.random.default_rng(3)
    rows = []
    for scale in (np.repeat([1.0, 0.1], 32), 1 / np.arange(1, 65), np.r_[np.ones(4), np.full(60, 0.02)]):
        for _ in range(200):
            x, e = rng.standard_normal((2, 64)) * scale
            x /= np.linalg.norm(x)
            e -= (e @ x) * x
            y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * e / np.linalg.norm(e)
            rows += [(len(rows), x.tolist(), len(rows) // 2), (len(rows) + 1, y.tolist(), len(rows) // 2)]
    got = cap_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 1, 2 * k) for i, _, k in rows}


def test_op2(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_knn.fit(docs, labels.where(~quality_knn.held_out()))
    got = quality_knn.score_documents(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(quality_knn.held_out()).toPandas()
    assert ((got.score >= 0.7) == (got.quality == 1)).mean() > 0.9 and got.score.between(0, 1).all()
    odd = quality_knn.score_documents(spark.createDataFrame([(1, None, 0.5), (2, "", 0.1)], "doc_id long, text string, score double"), model).collect()
    assert all(0 <= r.score <= 1 for r in odd)
    assert quality_knn.fit(docs, labels.limit(0)).score(np.zeros((2, quality_knn.FEATURES), np.float32)).tolist() == [0.5, 0.5]


def test_op2_votes(spark):
    """Scores against a plain reading of the votes, ties at the last places included; any order of the sample gives the same."""
    rng = np.random.default_rng(1)
    x = np.abs(rng.standard_normal((40, quality_knn.FEATURES))).astype(np.float32) * (rng.random((40, quality_knn.FEATURES)) < 0.02)
    x[20:30] = x[5]  # ten equal rows: they tie
    y = np.array([1, 0] * 20)
    idf, mean = np.ones(quality_knn.FEATURES), np.zeros(quality_knn.FEATURES)
    m = quality_knn.Model(x, y, idf, mean, 8, 7, 4.0)
    probe = np.concatenate([x[5:6], x[:4], np.zeros((1, quality_knn.FEATURES), np.float32)])
    got = m.score(probe)
    for z, s in zip(m._latent(probe[:5]), got):
        sim = (z @ m.known.T).astype(np.float64)
        last = np.sort(sim)[::-1][6]
        above, tie = sim > last + 1e-6, np.abs(sim - last) <= 1e-6
        w = np.maximum(sim, 1e-6) ** 4 * m.weight * (above + tie * (7 - above.sum()) / tie.sum())
        assert abs((w * y).sum() / w.sum() - s) < 1e-3
    assert got[5] == m.prior


def test_op2_odd_tables(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["good text here " * 9, "BAD!! " * 30, None, "", "x" * 200_000, "good text here " * 9])] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (5, 1), (None, 1), (3, 7), (2, None)], "doc_id long, quality int")
    model = quality_knn.fit(docs, labels)
    assert len(model.y) == 3
    got = {(r.doc_id, round(r.score, 9)) for r in quality_knn.score_documents(docs.withColumn("known", F.lit(1)), model).collect()}
    assert len(got) == 6 and all(0 <= s <= 1 for _, s in got) and {s for i, s in got if i in (2, 3)} == {round(model.prior, 9)}
    assert quality_knn.score_documents(docs.limit(0), quality_knn.fit(docs.limit(0), labels.limit(0))).collect() == []


def plain_lines(texts, widths):
    """(id, text without repeated lines) of every row, by all pairs of lines that share a shingle."""
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    strip = " \t\r\x0b\x0c"
    names = list(dict.fromkeys(x for _, t in order for y in t.split("\n") if (x := y.strip(strip))))
    find, join = union_find()
    for width, least, most in widths:
        sets, inv = {x: {x[i : i + width] for i in range(len(x) - width + 1)} for x in names if least <= len(x) <= most}, collections.defaultdict(list)
        for x, s in sets.items():
            for y, n in collections.Counter(y for k in s for y in inv[k]).items():
                if 100 * n >= 80 * (len(s) + len(sets[y]) - n):
                    join(x, y)
            for k in s:
                inv[k].append(x)
    seen, want = {}, collections.Counter()
    for i, t in order:
        keep, here = [], set()
        for line in t.split("\n"):
            if key := line.strip(strip):
                root = find(key)
                if root in here or seen.setdefault(root, i) != i:
                    continue
                here.add(root)
            keep.append(line)
        want[i, "\n".join(keep)] += 1
    return want


def test_op3(spark, docs, texts):
    got = collections.Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(docs.withColumn("gone", F.lit(1))).collect())
    fixed = collections.Counter({(i, t if t is not None else ""): n for (i, t), n in got.items()})
    assert fixed == plain_lines(texts, ((10, 10, 1 << 31),))


def test_stages_by_plain_readings(spark, docs, texts):
    """Each stage on the documents of sf0.001 and odd rows, with a clashing column, against a plain version of it."""
    import corpus_pipeline as C

    wide = docs.withColumns({"lang": F.lit("xx"), "gone": F.lit(1), "size": F.lit(2)})
    both = lambda df: collections.Counter((r.doc_id, r.text or "") for r in df.collect())
    base = spark.read.parquet(f"{D}/documents.parquet")
    model = quality_knn.fit(base, spark.read.parquet(f"{D}/labels.parquet").where(~quality_knn.held_out()))
    want = collections.Counter((r.doc_id, r.text or "") for r in quality_knn.score_documents(docs, model).collect() if r.score >= 0.7)
    out = C.quality(spark, wide, D)
    assert both(out) == want and out.columns == wide.columns
    out = C.lines(spark, wide, D)
    assert both(out) == plain_lines(texts, line_dedup.WIDTHS) and out.columns == wide.columns
    # rows of one id with other texts: a copy of document 0 and two of which nothing else has a word
    again = [(900008, texts[0][1]), (900008, " ".join(f"solo{k}" for k in range(30))), (900008, " ".join(f"alone{k}" for k in range(30)))]
    rows, wide_before = [*texts, *again], wide
    wide = wide.unionByName(spark.createDataFrame([(i, t, "xx", 1, 2) for i, t in again], wide.schema))
    find, join = union_find()
    sets = []
    for k, (i, t) in enumerate(rows):
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t))
        s = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())
        for j, u in sets:
            if i is not None and s and 100 * len(s & u) >= 80 * len(s | u):
                join(k, j)
        if i is not None:
            sets.append((k, s))
    groups, got = collections.defaultdict(set), both(C.near_duplicates(spark, wide, D))
    for k, (i, t) in enumerate(rows):
        groups[find(k)].add((i, t))
    # of each group one document, of the smallest id; all rows that are equal to it in id and text
    for members in groups.values():
        here = [m for m in members if m in got]
        assert len(here) == 1 and (None in {i for i, _ in members} or here[0][0] == min(i for i, _ in members))
        assert got[here[0]] == rows.count(here[0])
    assert sum(got.values()) == sum(rows.count(m) for g in groups.values() for m in g if m in got)
    assert all((i, t) in got for i, t in again[1:]) and C.near_duplicates(spark, wide, D).columns == wide.columns
    wide = wide_before
    masked = both(C.private_data(spark, wide, D))
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    assert sum(masked.values()) == len(texts) and not any(re.search(mail, t) for _, t in masked)
    assert sum(t.count("<EMAIL>") * n for (_, t), n in masked.items()) == sum(len(re.findall(mail, t)) for _, t in texts)
    clash = wide.withColumnRenamed("size", "bucket")
    packed = C.pack(spark, clash, D).collect()
    assert collections.Counter((r.doc_id, r.text, r.lang, r.gone, r.doc_bucket) for r in packed) == collections.Counter((r.doc_id, r.text, "xx", 1, 2) for r in docs.collect())
    assert all(r.n_tokens == max(1, len(WORD.findall(r.text or ""))) for r in packed)
    assert all(r.padded_length >= r.n_tokens and r.slot < max(1, 8192 // r.padded_length) for r in packed)
    assert len({(r.batch_id, r.slot) for r in packed}) == len(packed)
    for name, stage in C.STAGES:
        assert stage(spark, wide.limit(0), D).collect() == [], name


def test_op4(spark):
    for n in (0, 1, 191, 192, 193, 960, 961, 1920, 65025, 130000):
        p = ogg_media.padded(bytes(i * 31 % 256 for i in range(n)))
        media = ogg_media.mux(p)
        assert ogg_media.read_payload(media)[0] == p and len(ogg_media.demux(media)) == 2
        broken = bytearray(media)
        broken[len(media) // 2] ^= 1
        with pytest.raises(ogg_media.OggError):
            ogg_media.demux(bytes(broken))
    slow = 0
    for b in b"OggS test":
        slow ^= b << 24
        for _ in range(8):
            slow = ((slow << 1) ^ 0x04C11DB7 if slow & 0x80000000 else slow << 1) & 0xFFFFFFFF
    assert ogg_media.checksum(b"OggS test") == slow
    rows = ogg_media.media_features(ogg_media.store_media(spark.createDataFrame(ODD, "doc_id long, text string"))).collect()
    for r, (_, t) in zip(sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_bytes)), sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1] or "")))):
        assert r.payload_sha256 == hashlib.sha256(ogg_media.padded((t or "").encode())).hexdigest()


def test_op5(spark, docs, texts):
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(40):
        top = np.sort(rng.choice(np.arange(1, 60), rng.integers(1, 9), replace=False))
        n, k = rng.integers(1, 9, len(top)), int(rng.integers(1, 5))
        cost = lambda b: sum(c * (min(x for x in b if x >= t) - t) for t, c in zip(top, n))  # noqa: E731, B023
        best = min(cost((*c, top[-1])) for j in range(k) for c in itertools.combinations(top[:-1], j))
        assert cost(packing.optimal_bounds(top, n, top * n, k)) == best
    got = packing.pack(docs.withColumn("bucket", F.lit("x")), budget=2000, chunk=20).toPandas()
    assert len(got) == len(texts) and (got.padded_length >= got.n_tokens).all()
    assert sorted(got.n_tokens) == sorted(max(1, len(WORD.findall(t))) for _, t in texts)
    by = got.groupby("batch_id").agg(n=("slot", "size"), top=("slot", "max"), length=("padded_length", "first"), bucket=("bucket", "first"))
    assert (by.n == by.top + 1).all() and ((by.n * by.length <= 2000) | (by.n == 1)).all()
    full = (2000 // by.length).clip(lower=1)
    assert (by[by.n < full].groupby("bucket").size() <= 1).all()
    assert packing.pack(docs.limit(0)).count() == 0


def test_op6_decodes_without_join():
    """Ids select their bytes from one list: no rows of single ids are made, joined or sorted. Empty texts and any order of ids come back."""
    import public_tokenizers

    bpe = bpe_duckdb.Bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    bytes_of = {r: t for t, r in bpe.ranks.items()}
    rng = np.random.default_rng(5)
    ids = [[], [max(bytes_of), min(bytes_of)], *[rng.choice(list(bytes_of), n).tolist() for n in (1, 3000, 7)], []]
    assert bpe.decode([np.array(x, "<u4").tobytes() for x in ids]) == [b"".join(bytes_of[i] for i in x) for x in ids]
    assert bpe.decode([]) == []
    with pytest.raises(ValueError):
        bpe.decode([np.array([bpe.size], "<u4").tobytes()])
    assert "unnest" not in bpe_duckdb.DECODE.lower() and "order by" not in bpe_duckdb.DECODE.lower()


def test_op6(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = bpe_duckdb.Bpe(path, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = ["", "a" * 400, "<|endoftext|> x", "\x1c\x85   é😀漢字ſ ½ ²'s I'LL", " \n\n  x\t", "The quick brown fox " * 9] + [r.text for r in spark.read.parquet(f"{D}/documents.parquet").limit(40).collect()]
    rng = np.random.default_rng(6)
    texts += ["".join(rng.choice(list("abcdeénr漢"), n)) for n in (700, 1500, 100_000)] + ["ab" * 50_000]
    ids = bpe.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [enc.encode_ordinary(t) for t in texts]
    assert bpe.decode(ids) == [t.encode() for t in texts]
    df = bpe_duckdb.decode_column(bpe_duckdb.encode_column(spark.createDataFrame(ODD, "doc_id long, text string"), path, P.PATTERN), path, P.PATTERN)
    assert sorted(bytes(r.decoded).decode() for r in df.collect()) == sorted(t or "" for _, t in ODD)
    assert bpe_duckdb.encode_column(spark.createDataFrame([], "doc_id long, text string, ids int"), path, P.PATTERN).collect() == []
    words = ["".join(rng.choice(list("abcde"), n)) for n in range(2, 60)]
    assert [bpe._merge_long(w.encode()) for w in words] == bpe._merge([w.encode() for w in words])


def test_op7(docs, texts):
    long = [(i, WORD.findall(t)) for i, t in texts]
    first = {}
    for i, w in long:
        if i is not None:
            for p in range(len(w) - 49):
                k = tuple(w[p : p + 50])
                first[k] = min(first.get(k, i), i)
    want = collections.Counter()
    for i, w in long:
        keep = [True] * len(w)
        for p in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[p : p + 50])] < i:
                keep[p : p + 50] = [False] * 50
        kept = [x for x, k in zip(w, keep) if k]
        want[i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == want and sum(k[2] for k in want) > 0


@pytest.mark.parametrize("name", ["op7_substring_dedup", "op10_ngram_jaccard"])
def test_sql(spark, name):
    import oracle

    from karstline.llm import queries

    assert oracle.compare(spark, queries.QUERIES[name], queries.ORACLE[name], D) >= 200


def test_op7_repeated_ids(spark):
    """Rows of one id with other texts are rows of their own; tables without rows; clashing columns."""
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    a, b = word(120), word(260)
    rows = [(1, " ".join(a)), (5, " ".join(["z", *a])), (5, "short"), (5, " ".join(b)), (5, " ".join(b)), (7, " ".join(b[100:]))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, starts int")
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert got == collections.Counter([(1, 120, 0), (5, 121, 120), (5, 1, 0), (5, 260, 0), (5, 260, 0), (7, 160, 160)])
    assert substring_dedup.substring_dedup(df.limit(0)).collect() == []


def test_op5_bounds_and_hot_ids(spark):
    """Bounds against all choices; ten thousand rows of one id are spread over chunks and fill batches."""
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(30):
        top = np.unique(rng.integers(1, 5000, rng.integers(1, 9)))
        n = rng.integers(1, 50, len(top))
        pad = lambda bs: sum(int(k) * (min(b for b in bs if b >= t) - int(t)) for t, k in zip(top, n))
        best = min(pad({*c, int(top[-1])}) for r in range(3) for c in itertools.combinations(top.tolist(), r))
        assert pad(packing.optimal_bounds(top, n, top * n, 3)) == best
    docs = spark.range(12_000).select(F.when(F.col("id") % 6 > 0, F.lit(7)).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    out = packing.pack(docs, budget=30, chunk=500)
    per = out.groupBy("batch_id").count().collect()
    assert out.count() == 12_000 and sorted(r["count"] for r in per)[0] == 10 and len(per) == 1200
    assert packing.pack(docs.limit(0)).collect() == []


def test_op9_long_and_empty(spark):
    """Thousands of matches in one text, near context on both sides, secrets, empty table, clashing columns."""
    text = " ".join(f"a{i}@b{i}.org" for i in range(6000))
    more = "0171 2345678 tel, token = '04dbebab91ab85687d33' password: aaaaaaaaaaaaaaaaaaaa"
    rows = [(1, text, 0), (2, more, 0), (3, None, 0), (4, "hotel 0171 2345678901 repay", 0)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, email int")).collect()}
    want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert got[1].n_email == 6000 and got[1].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in want)
    assert [x.split(":")[0] for x in got[2].spans.split(",")] == ["national", "secret"] and got[3].spans == got[4].spans == ""
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_difference_cover():
    for v in (1, 2, 3, 7, 13, 31, 50, 97):
        c = substring_dedup.difference_cover(v)
        assert {(a - b) % v for a in c for b in c} == set(range(v))


def test_op8(spark):
    rows = [(1, 0, "user", "Hello world.\nHow are you?"), (1, 1, "assistant", "On Monday X wrote:\n> How are you?\nFine."), (1, 2, "user", "> Fine.\n>> How are you?\nGood"),
            (1, 3, "user", "> hello,  WORLD\nlate"), (2, 0, None, None), (None, 1, "a", "> x"), (2, 1, "user", "> nothing")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("thread", F.lit("clash"))
    got = {(r.conv_id, r.turn): (r.parent, r.thread, r.depth, r.n_quoted, r.message) for r in quote_chat.reply_chats(df).collect()}
    assert got[1, 1] == (0, 0, 1, 1, "<|assistant|>\nFine.<|end|>") and got[1, 2] == (1, 0, 2, 2, "<|user|>\nGood<|end|>")
    assert got[1, 3] == (0, 0, 1, 1, "<|user|>\nlate<|end|>") and got[2, 1] == (None, 1, 0, 1, "<|user|>\n<|end|>") and got[None, 1][0] is None
    assert quote_chat.reply_chats(df.limit(0)).count() == 0


def test_op8_wrapped_otherwise(spark):
    """One paragraph quoted as several lines, several lines quoted as one, a part of a sentence, and a short quote."""
    long = "The river had risen in the night and nobody could say when the ferry would run again. Ask the miller, he knows."
    rows = [(1, 0, "user", long), (1, 1, "a", "> The river had risen in the night and nobody\n> could say when the ferry would run\n> again. Ask the miller,\n> he knows.\nI will."),
            (2, 0, "user", "The river had risen in the night\nand nobody could say when\nthe ferry would run again."), (2, 1, "a", "other"), (2, 2, "user", "> The river had risen in the night and nobody could say when the ferry would run again.\nYes"),
            (3, 0, "user", "before"), (3, 1, "a", long), (3, 2, "user", "> risen in the night and\n> nobody could say when the\nOh"),
            (4, 0, "user", "before"), (4, 1, "a", "Ask the miller."), (4, 2, "user", "> > Ask\n> > the miller.\n> nothing said\nWho?"),
            (5, 0, "user", long), (5, 1, "a", "> the ferry to the island would\n> run as it always had, they said\nNo link"),
            (6, 0, "user", "Intro\n\nAsk the\nmiller"), (6, 1, "a", "> Ask the miller\nWhy")]
    got = {(r.conv_id, r.turn): (r.parent, r.thread) for r in quote_chat.reply_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert {k: v for k, v in got.items() if v[0] is not None} == {(1, 1): (0, 0), (2, 2): (0, 0), (3, 2): (1, 1), (4, 2): (1, 1), (6, 1): (0, 0)}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    digits = re.sub(r"\D", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_op8_threads(spark):
    """Generated conversations against a plain reading: each reply quotes one earlier message, wrapped anew; some lines are said by all."""
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(rng.choice(["ba", "co", "di", "fu", "ga", "hel", "ip", "jo", "kra", "lum"], n)).capitalize() + "."
    rows, want = [], {}
    for conv in range(12):
        said, parent = [], []
        for turn in range(90 if conv == 0 else 10):
            quote = int(rng.integers(0, turn)) if turn and rng.random() < 0.8 else None
            body = words(int(rng.integers(9, 30)))
            text = f"Ok.\n{body}"
            if quote is not None:
                flat = said[quote].split(" ")
                cut = int(rng.integers(1, len(flat)))
                text = f"On Monday X wrote:\n> {' '.join(flat[:cut])}\n> {' '.join(flat[cut:])}\n{text}"
            said.append(body)
            parent.append(quote)
            rows.append((conv, turn, "user", text))
            start = turn
            while parent[start] is not None:
                start = parent[start]
            want[conv, turn] = (quote, start, f"<|user|>\nOk.\n{body}<|end|>")
    # a short line is found in the last message before that says it; a forged marker is broken
    rows += [(90, 0, "a", "ok"), (90, 3, "a", "ok"), (90, 4, "b", "> ok\nyes <|end|>"), (90, 70, "b", "> ok\nno"), (None, 1, "a", "> ok"), (90, None, "a", "ok")]
    want |= {(90, 0): (None, 0, "<|a|>\nok<|end|>"), (90, 3): (None, 3, "<|a|>\nok<|end|>"), (90, 4): (3, 3, "<|b|>\nyes < |end|><|end|>"), (90, 70): (3, 3, "<|b|>\nno<|end|>")}
    out = quote_chat.reply_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows)
    assert {(r.conv_id, r.turn): (r.parent, r.thread, r.message) for r in out if r.conv_id is not None and r.turn is not None} == want
    for conv in {c for c, _ in want}:
        mine = sorted((t[1], k[1]) for k, t in want.items() if k[0] == conv)
        assert {(r.position, r.thread, r.turn) for r in out if r.conv_id == conv and r.turn is not None} == {(i, a, b) for i, (a, b) in enumerate(mine)}
    assert quote_chat.reply_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_op1_dimensions(spark):
    """Planted pairs just over 0.98 of few dimensions and of sparse vectors; empty table; clashing columns."""
    rng = np.random.default_rng(13)
    rows = []
    for dim, kind in ((2, 0), (3, 0), (4, 0), (6, 0), (64, 1), (64, 2)):
        for _ in range(150):
            x, e = rng.standard_normal((2, dim))
            if kind:
                x = np.where(np.isin(np.arange(dim), rng.choice(dim, kind, replace=False)), x, 1e-3 * x)
            x /= np.linalg.norm(x)
            e -= (e @ x) * x
            y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * e / np.linalg.norm(e)
            rows += [(len(rows), x.tolist(), len(rows) // 2, 0), (len(rows) + 1, y.tolist(), len(rows) // 2, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, root int")
    got = cap_neardup.near_duplicates(df).collect()
    # every pair has a label of its own: filters are the same, so a miss is a miss of the code
    assert sum(r.n_links for r in got) >= 0.999 * len(rows) and all(r.n_links < 2 for r in got)
    assert cap_neardup.near_duplicates(df.limit(0)).collect() == []


def test_op9(spark, docs, texts):
    more = ["a@b.c_d@e.f x@y..z q@w.e.", "1.2.3.4.5 256.1.1.1 0001.2.3.255 é😀 1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 " + "1" * 9000, "+1 (555) 123-4567 +123 ++44 20 7946 0958.", "a" * 20000 + "@", "0." * 300,
            "IBAN GB82 WEST 1234 5698 7654 32, DE89370400440532013001", "call tel 030 1234 5678"]
    df = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.base_sha256) for r in pii.find_pii(df).collect())
    want = collections.Counter()
    for i, t in [*texts, *[(10**6 + i, t) for i, t in enumerate(more)]]:
        spans = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, t) if passes(k, m[0]))
        want[i, hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in spans).encode()).hexdigest()] += 1
    assert got == want
    spans = {r.doc_id: r.spans for r in pii.find_pii(df.where("doc_id >= 1000006")).collect()}
    assert spans == {10**6 + 6: "iban:5:32", 10**6 + 7: "national:9:22"}
    masked = {r.doc_id: r.text for r in pii.mask(df.where("doc_id >= 1000000").withColumn("m", F.lit(3))).collect()}
    assert masked[10**6 + 6].startswith("IBAN <IBAN>, DE89") and masked[10**6 + 7] == "call tel <NATIONAL>" and masked[10**6].startswith("<EMAIL><EMAIL> x@y..z <EMAIL>.")


def test_op10(docs, texts):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = collections.defaultdict(frozenset)
    for i, t in texts:
        w = WORD.findall(low(t))
        sets[i] = frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    find, join = union_find()
    real = [i for i in sets if i is not None]
    for a in real:
        for b in real:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                join(a, b)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs.withColumn("size", F.lit("x"))).collect())
    assert got == collections.Counter((i, len(sets[i]), None if i is None else find(i)) for i, _ in texts)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_op10_near_copies(spark):
    """A group of near copies of which some pairs link and others do not."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.choice(200, rng.integers(0, 6), replace=False):
            w[p] = f"e{i}_{p}"
        rows.append((i, " ".join(w)))
    sets = {i: set(zip(*[t.split()[k:] for k in range(3)])) for i, t in rows}
    find, join = union_find()
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                join(a, b)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets} and 1 < len(set(got.values())) < 60


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{D}/documents.parquet")
    for name, stage in C.STAGES:
        out = stage(spark, docs, D)
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert out.count() == docs.count() > 100


def test_line_kernels():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdé ß漢😀"), n)) for n in (0, 3, 9, 10, 11, 60, 400, 5000)]
    x, y = [], []
    for t in base:
        for cuts in (0, 1, 3):
            u = list(t)
            for p in rng.integers(0, len(u), cuts) if u else []:
                u[p] = "#"
            x.append(t)
            y.append("".join(u))
    got = line_dedup._similar(pa.array(x, pa.large_string()), pa.array(y, pa.large_string()), 10, 80)
    for s, t, g in zip(x, y, got):
        a, b = ({v[i : i + 10] for i in range(len(v) - 9)} for v in (s, t))
        assert g == (100 * len(a & b) >= 80 * len(a | b))
    raw = [v.encode() for v in base]
    bounds = np.cumsum([0, *map(len, raw)])
    has, words = line_dedup._bands(np.frombuffer(b"".join(raw), np.uint8), bounds, 10, 2, 12, 3)
    assert has.tolist() == [len(v) >= 10 for v in base]
    assert words.shape == (has.sum(), 12) and set((words & 7).ravel().tolist()) == {2}


def test_op3_odd_tables(spark):
    def run(rows):
        return {(r.doc_id, r.text, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    assert run([]) == set()
    assert run([(1, None), (2, ""), (3, "short\nshort")]) == {(1, None, 0), (2, "", 0), (3, "short", 1)}


def test_op3_repeated_ids(spark):
    """Rows of one id with other texts: one line of the component stays, in the row whose text has the smaller hash."""
    line = "aaa bbb ccc ddd"
    rows = [(1, f"{line}\nx"), (1, f"{line}\ny"), (2, line), (1, f"{line}\nx")]
    got = collections.Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    x, y = collections.Counter({(1, f"{line}\nx"): 2, (1, "y"): 1, (2, ""): 1}), collections.Counter({(1, f"{line}\ny"): 1, (1, "x"): 2, (2, ""): 1})
    assert got in (x, y)


def test_op3_recall(spark):
    """Planted pairs of lines at a similarity of 0.80 to 0.83."""
    rng = np.random.default_rng(12)
    rows, letters = [], list("abcdefghijklmnopqrstuvwxyz ")
    while len(rows) < 1600:
        a = "q" + "".join(rng.choice(letters, int(rng.integers(61, 300)))) + "q"
        b = list(a)
        x = {a[i : i + 5] for i in range(len(a) - 4)}
        while True:
            b[int(rng.integers(1, len(b) - 1))] = "#"
            y = {"".join(b[i : i + 5]) for i in range(len(b) - 4)}
            if (j := len(x & y) / len(x | y)) < 0.83:
                break
        if j >= 0.8:
            rows += [(len(rows), a), (len(rows) + 1, "".join(b))]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), widths=line_dedup.WIDTHS)
    assert out.agg(F.sum("n_removed")).first()[0] >= 0.998 * len(rows) / 2


def test_op3_is_native(spark):
    """No plan of lines runs Python, and the SQL kernels find what the numpy ones do."""
    import pyarrow as pa

    rows = [(i, f"line {i} of some words that stand alone {i * i}\nline {i // 2} that two of them share, word by word") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = docs.select("text")
    plans = [line_dedup.placed_lines(docs), line_dedup._signed(text, line_dedup.WIDTHS, 24, 5), line_dedup._texts(text)]
    plans += [line_dedup._cells(plans[2], line_dedup.WIDTHS), line_dedup.line_dedup(docs, widths=line_dedup.WIDTHS)]
    for df in plans:
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
    rng = np.random.default_rng(6)
    x = ["".join(rng.choice(list("abé漢😀 "), n)) for n in (0, 9, 10, 11, 40, 90, 400, 4000) for _ in range(4)]
    y = ["".join("#" if rng.random() < 0.012 else c for c in v) for v in x]
    got = line_dedup.similar(spark.createDataFrame([(k, k, v, w) for k, (v, w) in enumerate(zip(x, y))], "a long, b long, x string, y string"), ((10, 10, 1 << 31),), 80)
    want = line_dedup._similar(pa.array(x, pa.large_string()), pa.array(y, pa.large_string()), 10, 80)
    assert {r.a for r in got.collect()} == {k for k, v in enumerate(x) if len(v) >= 10 and want[k]} and 0 < want.sum() < len(x)


def test_op3_small_sets(spark):
    """Lines whose sets have few members, at a similarity of exactly 0.8: eight of ten shared."""
    rng, rows = np.random.default_rng(9), []
    while len(rows) < 120:
        base = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 12, replace=False))
        rows += [(len(rows), base), (len(rows) + 1, base + "#~"), (len(rows) + 2, "".join(rng.choice(list("0123456789"), 12)))]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), widths=((5, 10, 1 << 31),))
    assert {r.doc_id for r in out.where("n_removed > 0").collect()} == {r[0] for r in rows if r[0] % 3 == 1}


def test_op3_cut_points(spark, monkeypatch):
    """Signatures are written for one part of the bands at a time, without texts, and deleted before the next; places of lines hold no texts either."""
    import os

    real, seen = line_dedup.cut, []

    def cut(df, name="cut", **more):
        alive = [f for f in seen if "buckets" in f.columns and os.path.exists(f._cut_path)]
        out = real(df, name, **more)
        seen.append(out)
        assert not ("buckets" in out.columns and alive), name
        return out

    monkeypatch.setattr(line_dedup, "cut", cut)
    rows = [(i, f"line {i} of some words that stand alone {i * i}\nline {i // 2} that two of them share, word by word") for i in range(40)]
    assert line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), widths=line_dedup.WIDTHS).where("n_removed > 0").count() > 0
    signed = [f for f in seen if "buckets" in f.columns]
    assert len(signed) == 3 and not any("line" in f.columns for f in signed) and not any(os.path.exists(f._cut_path) for f in signed)


def test_op3_pairs_fit_in_size(spark, monkeypatch):
    """Of lines that share buckets, those whose sets are too unequal are no pairs; the others are tested at the width that they met at."""
    from karstline.llm import common

    real, seen = common.cut, []

    def cut(df, name="cut", **more):
        out = real(df, name, **more)
        if name == "pairs":
            seen.extend(tuple(r) for r in out.collect())
        return out

    monkeypatch.setattr(common, "cut", cut)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    lines = [x for _ in range(40) for x in [word(200)] for x in (x[:130], x)]
    near = word(120)
    rows = list(enumerate([*lines, near, near[:60] + "#" + near[61:]]))
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), widths=line_dedup.WIDTHS)
    assert {r.doc_id for r in out.where("n_removed > 0").collect()} == {81}
    assert {x[2:] for x in seen} == {(0,)} and len({x[:2] for x in seen}) == 1


def test_link_buckets_rows(spark):
    """A bucket of 3,000 members that don't link: what is offered for verification does not grow with its square."""
    n, seen = 3000, []
    post = spark.range(n).select(F.lit(1).cast("long").alias("bucket"), "id", F.col("id").alias("v"))

    def verify(pairs):
        seen.append(pairs.count())
        return pairs.where("a = b + 1 and b % 100 = 0")

    got = link_buckets(post, verify, sketch=lambda rows: rows.withColumn("w", F.col("v")), near="abs(l.w - r.w) <= 1")
    assert sum(seen) <= 5 * n
    assert {(r.v, r.root) for r in got.collect()} == {(i + d, i) for i in range(0, n, 100) for d in (0, 1)}


def test_op3_one_character_edits(spark, tmp_path, monkeypatch):
    """Lines of 20 to 130 characters with one inner character changed go; in the query and in the pipeline's stage."""
    import corpus_pipeline as C

    from karstline.llm import queries

    rng = np.random.default_rng(8)
    rows = []
    for n in [*range(20, 131, 2)]:
        line = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789é"), n))
        at = int(rng.integers(5, n - 5))
        rows += [(len(rows), line, "xx", "test", n), (len(rows) + 1, line[:at] + "#" + line[at + 1 :], "xx", "test", n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    want = {(r[0], r[1] if r[0] % 2 == 0 else "") for r in rows}
    assert {(r.doc_id, r.text) for r in C.lines(spark, docs, D).collect()} == want
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    assert {(r.doc_id, r.n_removed) for r in queries.fuzzy_lines(spark, D).collect()} == {(r[0], r[0] % 2) for r in rows}


def test_op3_widths(spark, texts):
    """Components at several widths against brute force over all pairs."""
    lines = sorted({x for _, t in texts for y in t.split("\n") if (x := y.strip(" \t\r\x0b\x0c"))})
    find, join = union_find()
    for width, least, most in line_dedup.WIDTHS:
        sets, inv = {x: {x[i : i + width] for i in range(len(x) - width + 1)} for x in lines if least <= len(x) <= most}, collections.defaultdict(list)
        for x, s in sets.items():
            for y, n in collections.Counter(y for k in s for y in inv[k]).items():
                if 100 * n >= 80 * (len(s) + len(sets[y]) - n):
                    join(x, y)
            for k in s:
                inv[k].append(x)
    want = collections.Counter(find(x) for x in lines)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = line_dedup.line_dedup(docs, widths=line_dedup.WIDTHS).where("n_removed = 0").count()
    assert got == len(want) < len(lines)
