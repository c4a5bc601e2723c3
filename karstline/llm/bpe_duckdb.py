"""Byte-level BPE by recursive DuckDB queries, one database a Python worker.

Ranks come from a file in tiktoken's format, whose path is a parameter. Texts are cut
by the pattern; each match that is no token itself becomes rows (place, token) of its bytes,
the place being word and position in one integer. A recursive query joins neighbouring rows
with the merge table, contracts the leftmost pair of least rank of each word, and goes on with the words
that still had one, until none has: the same order of merges as tiktoken's. Decoding
selects the bytes of ids, in their order, from the vocabulary as one list.

Words go to the query in groups of at most WORD_BYTES bytes. Answers are kept in a
dictionary of at most CACHE_WORDS words a worker, emptied when full: it saves work and
has no influence on results. A word of n bytes takes up to n rounds over its rows, which
grows with its square; matches of over LONG bytes therefore contract the same pairs in the same
order from a heap, one at a time, so a text without any break ends too.

Null and empty texts have no tokens. Ids that are not in the vocabulary raise. Repeated rows
give equal rows, empty tables an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WORD_BYTES = 1 << 19
CACHE_WORDS = 800_000
LONG = 4096

MERGE = """
WITH RECURSIVE step(place, id, busy) AS (
  SELECT place, id, true FROM start
  UNION ALL
  (WITH neighbours AS (
     SELECT place, id, lead(id) OVER (ORDER BY place) AS next, lead(place) OVER (ORDER BY place) AS after FROM step WHERE busy),
   pairs AS MATERIALIZED (
     SELECT place, n.id, after, rank FROM neighbours n
     LEFT JOIN merges m ON m.pair = (n.id << 32) + next AND (place >> 32) = (after >> 32)),
   best AS (
     SELECT place >> 32 AS word, min((rank << 32) + (place & 4294967295)) AS least, arg_min(after, (rank << 32) + (place & 4294967295)) AS gone
     FROM pairs GROUP BY word)
   SELECT place, CASE WHEN (place & 4294967295) = (least & 4294967295) THEN least >> 32 ELSE p.id END, least IS NOT NULL
   FROM pairs p JOIN best ON place >> 32 = word WHERE gone IS DISTINCT FROM place)
)
SELECT place >> 32 AS word, list(id ORDER BY place) AS ids FROM step WHERE NOT busy GROUP BY word ORDER BY word
"""

DECODE = "SELECT d, unhex(array_to_string(list_select(hex, places), '')) AS bytes FROM given, vocabulary"


class Bpe:
    """Tokenizer of one vocabulary; holds a DuckDB database in memory."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, int] = {}
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[(a << 32) + b] = r
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        as_table = lambda **c: pa.table({k: pa.array(v) for k, v in c.items()})
        self.db.register("m0", as_table(pair=list(self.pairs), rank=list(self.pairs.values())))
        self.db.register("v0", as_table(id=list(self.ranks.values()), hex=[t.hex() for t in self.ranks]))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m0; CREATE TABLE vocabulary AS SELECT list(coalesce(hex, '') ORDER BY n) AS hex FROM range((SELECT max(id) + 1 FROM v0)) r(n) LEFT JOIN v0 ON id = n")
        self.size = max(self.ranks.values()) + 1

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = (np.repeat(np.arange(len(words)), lengths) << 32) + np.arange(len(flat)) - first
        self.db.register("start", pa.table({"place": place, "id": flat}))
        ids = self.db.sql(MERGE).to_arrow_table()["ids"].combine_chunks()
        self.db.unregister("start")
        values, offs = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        return [values[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])]

    def _merge_long(self, word: bytes) -> bytes:
        """The same contractions, leftmost pair of least rank first, from a heap over linked neighbours."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.pairs.get((ids[i] << 32) + ids[after[i]]) if after[i] < n else None
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been contracted since
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
        group, size = [], 0
        for word in new:
            raw = word.encode()
            if (r := self.ranks.get(raw)) is not None:
                self.words[word] = r.to_bytes(4, "little")
                continue
            if len(raw) > LONG:
                self.words[word] = self._merge_long(raw)
                continue
            group.append((word, raw))
            size += len(raw)
            if size >= WORD_BYTES:
                self._learn_group(group)
                group, size = [], 0
        if group:
            self._learn_group(group)

    def _learn_group(self, group: list[tuple[str, bytes]]) -> None:
        for (word, _), ids in zip(group, self._merge([raw for _, raw in group])):
            self.words[word] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) for t in texts]
        missing = set().union(*cut) - self.words.keys()
        if len(self.words) + len(missing) > CACHE_WORDS:
            self.words.clear()
            missing = set().union(*cut)
        self._learn(missing)
        return [b"".join(map(self.words.__getitem__, c)) for c in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        lengths = [len(x) // 4 for x in ids]
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        if len(flat) and not set(np.unique(flat).tolist()) <= self._known:
            raise ValueError("an id is not in the vocabulary")
        offs = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat + 1))  # lists count from 1
        self.db.register("given", pa.table({"d": pa.array(np.arange(len(ids))), "places": places}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("given")
        out = [b""] * len(ids)
        for d, b in zip(got["d"].to_pylist(), got["bytes"].to_pylist()):
            out[d] = b or b""
        return out

    @functools.cached_property
    def _known(self) -> set[int]:
        return set(self.ranks.values())


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def encode_column(docs: DataFrame, path: str, pattern: str, batch: int = 200) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers)."""
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(path, pattern)
        for whole in batches:
            for k in range(0, len(whole), batch):
                b = whole.slice(k, batch)
                texts = b.column(b.schema.get_field_index("text")).fill_null("").to_pylist()
                yield pa.record_batch([b.column(b.schema.get_field_index("doc_id")), pa.array(bpe.encode(texts), pa.binary())], ["doc_id", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary")


def decode_column(ids: DataFrame, path: str, pattern: str, batch: int = 200) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, decoded."""
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        bpe = tokenizer(path, pattern)
        for whole in batches:
            for k in range(0, len(whole), batch):
                b = whole.slice(k, batch)
                raw = [x or b"" for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
                back = bpe.decode(raw)
                cols = [pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(map(sha, raw), pa.string()), pa.array(map(sha, back), pa.string()), pa.array(back, pa.binary())]
                yield pa.record_batch([b.column(b.schema.get_field_index("doc_id")), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded binary")
