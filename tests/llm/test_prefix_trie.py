"""op13: tries against a plain reading: random, deep, copied and odd conversations."""

import collections
import hashlib
import re
import zlib

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from karstline.llm import prefix_trie, queries

D = "/root/testdata/sf0.001"
KINDS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(convs):
    """Nodes of {conv_id: [(role, text), ...]}, from the deepest up."""
    members = collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children, below = collections.Counter(k[:-1] for k in members if k), collections.defaultdict(lambda: [0, 0])
    out = {}
    for k in sorted(members, key=len, reverse=True):
        m = members[k]
        leaves, saved = below[k]
        leaves += not children[k]
        saved += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        if k:
            up = below[k[:-1]]
            up[0], up[1] = up[0] + leaves, up[1] + saved
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(k))
        out[m[0], len(k)] = (members[k[:-1]][0] if k else None, len(m), children[k], leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def ordered(rows):
    out = collections.defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out[c].append((role or "", text or ""))
    return dict(out)


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def nodes(df):
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}
    assert len(got) == df.count()
    return got


def both(spark, rows):
    df = spark.createDataFrame(rows, KINDS).withColumns({"depth": F.lit("x"), "rank": F.lit(1), "base": F.lit(2)}).repartition(5)
    convs = ordered(rows)
    assert nodes(prefix_trie.conversation_trie(df)) == plain(convs)
    assert nodes(prefix_trie.trie(*prefix_trie.shared_heads(*prefix_trie.numbered(df)))) == plain(rebuilt(convs))


def test_random(spark):
    rng = np.random.default_rng(1)
    both(spark, [(c, t, "ua"[t % 2], "w " * int(rng.integers(0, 3))) for c in range(0, 130) if c % 7 for t in range(int(rng.integers(0, 9)))])


def test_copies_and_a_comb(spark):
    """A third of the conversations are equal, and others each leave one long conversation a turn later than the last."""
    same = [(c, t, "u", f"same {t}") for c in range(0, 300, 3) for t in range(5)]
    comb = [(c, t, "u", f"long {t} x") for c in range(1, 120, 3) for t in range(c + 1)]
    off = [(c + 1000, t, "u", f"long {t} x" if t < c else "off") for c in range(1, 120, 3) for t in range(c + 1)]
    both(spark, same + comb + off)


def test_odd_rows(spark):
    rows = [
        (20, None, "u", "null turn first"), (20, -1, None, None), (20, 2, "", ""), (21, 0, "u", "x y"), (21, 5, "u", "z"), (None, 0, "u", "no id"), (45, 3, "ab", "c"), (46, 3, "a", "bc"),
        (47, 1, "u", "long " * 100_000), (48, 1, "u", "long " * 100_000), (-5, 1, "u", "below"), (-25, 1, "u", "below"), (60, 1, None, "n"), (61, 1, "", "n"),
    ]
    convs = ordered(rows)
    got = nodes(prefix_trie.conversation_trie(spark.createDataFrame(rows, KINDS)))
    assert got == plain(convs)
    twice = spark.createDataFrame([(1, 1, "u", "a b"), (1, 1, "u", "a b"), (2, 1, "u", "a b")], KINDS)
    assert nodes(prefix_trie.conversation_trie(twice)) == plain({1: [("u", "a b")] * 2, 2: [("u", "a b")]})
    for f in (prefix_trie.conversation_trie, lambda x: prefix_trie.trie(*prefix_trie.shared_heads(*prefix_trie.numbered(x)))):
        assert f(twice.limit(0)).collect() == []


def test_long_conversations(spark, monkeypatch):
    """More turns than a block holds, and more members ending at a node than a piece holds."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    rows = [(c, t, "u", f"t{t} w" if t < cut else f"c{c} w") for c, n, cut in ((0, 300, 300), (20, 300, 170), (40, 90, 90), (60, 301, 300)) for t in range(n)]
    both(spark, rows + [(c, 0, "u", "end") for c in range(100, 400)])


def test_rounds_are_few(spark, monkeypatch):
    """200 conversations, each a turn shorter than the next: peeling takes rounds by the logarithm, not 200."""
    seen = []
    old = prefix_trie.cut
    monkeypatch.setattr(prefix_trie, "cut", lambda df, name: seen.append(name) or old(df, name))
    rows = [(c, t, "u", str(t)) for c in range(200) for t in range(c + 1)]
    assert nodes(prefix_trie.conversation_trie(spark.createDataFrame(rows, KINDS))) == plain(ordered(rows))
    assert seen.count("chains") < 25


def test_query(spark):
    assert oracle.compare(spark, queries.QUERIES["op13_prefix_trie"], queries.ORACLE["op13_prefix_trie"], D) > 0
