"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_duckdb, cap_neardup, importance, jaccard_join, line_dedup, ogg_media, packing, pii, prefix_trie, quality_knn, quote_chat, substring_dedup, warc_zst
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ACCEPT = 0.7


def embedding_neardup(spark: SparkSession, d: str) -> DataFrame:
    return cap_neardup.near_duplicates(table(spark, d, "embeddings"))


def quality(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality_knn.fit(docs, table(spark, d, "labels").where(~quality_knn.held_out()))
    scored = quality_knn.score_documents(docs, model)
    return scored.select(
        "doc_id", quality_knn.held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def fuzzy_lines(spark: SparkSession, d: str) -> DataFrame:
    """Digest of line_dedup: counts and SHA-256 of the text that stays."""
    from pyspark.sql import functions as F

    out = line_dedup.line_dedup(table(spark, d, "documents").select("doc_id", "text"), widths=line_dedup.WIDTHS)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def media(spark: SparkSession, d: str) -> DataFrame:
    return ogg_media.media_features(ogg_media.store_media(table(spark, d, "documents")))


def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return bpe_duckdb.decode_column(bpe_duckdb.encode_column(table(spark, d, "documents"), path, pattern), path, pattern).drop("decoded")


def substrings(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, d, "documents")).drop("kept_text")


def quotations(spark: SparkSession, d: str) -> DataFrame:
    return quote_chat.reply_chats(table(spark, d, "conversations"))


def private_data(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(table(spark, d, "documents"))


def ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


def archives(spark: SparkSession, d: str) -> DataFrame:
    return warc_zst.round_trip(table(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def importance_draw(spark: SparkSession, d: str) -> DataFrame:
    out = importance.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def conversation_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.shared_heads(*prefix_trie.numbered(table(spark, d, "conversations"))))


QUERIES = {
    "op1_embedding_neardup": embedding_neardup,
    "op2_quality_classifier": quality,
    "op3_line_dedup": fuzzy_lines,
    "op4_media_ogg": media,
    "op5_packing": length_buckets,
    "op6_byte_bpe": bpe,
    "op7_substring_dedup": substrings,
    "op8_quotation_linking": quotations,
    "op9_pii": private_data,
    "op10_ngram_jaccard": ngram_jaccard,
    "op11_warc_zst": archives,
    "op12_importance_resampling": importance_draw,
    "op13_prefix_trie": conversation_prefixes,
}

#: crc32 of the bytes of a text of which `hex` is the hexadecimal form, by a table of 256 remainders in the CTE crc_table(t).
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(0, 256) r(i)))"""
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(hex) // 2), lambda k: CAST('0x' || substr(hex, CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295)"""

#: DuckDB forms where SQL can express the result on whole tables in reasonable time; the others are tested by brute force.
ORACLE = {
    "op1_embedding_neardup": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
roots AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept FROM e JOIN roots r ON r.x = e.vec_id
""",
    "op7_substring_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
first AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN first USING (s) WHERE lo < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""",
    "op10_ngram_jaccard": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(ws[i : i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN n p ON p.doc_id = a.doc_id JOIN sh b ON b.s = a.s AND b.doc_id <> a.doc_id JOIN n q ON q.doc_id = b.doc_id
  WHERE 100 * p.n >= 90 * q.n AND 100 * q.n >= 90 * p.n GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(y) FROM reach WHERE x = w.doc_id), w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
""",
    "op11_warc_zst": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS n, h, array_to_string(list_transform(range(0, 8), lambda i: list_transform([CAST('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)],
  lambda x: concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1),
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)))[1]), '') AS b32 FROM p),
t AS (SELECT h, n, max(page_id) AS top FROM d GROUP BY h, n)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, b32 AS payload_digest, CASE WHEN d.page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN d.page_id < top THEN top END AS refers_to FROM d JOIN t ON t.h = d.h AND t.n = d.n
""",
    "op12_importance_resampling": f"""
WITH {_CRC_TABLE},
w AS (SELECT 0 AS target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
f AS (SELECT target, doc_id, unnest(ws) AS x FROM w),
b AS (SELECT x, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT x, hex(x) AS hex FROM f), crc_table),
c AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM f JOIN b USING (x) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM c) + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM c) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM c),
d AS (SELECT w.doc_id, len(ws) AS n, coalesce(CAST(floor(m.total / len(ws)) AS BIGINT), 0) AS weight FROM w LEFT JOIN
  (SELECT doc_id, CAST(sum(gain) AS DOUBLE) AS total FROM f JOIN b USING (x) JOIN g USING (bucket) WHERE target = 0 GROUP BY doc_id) m USING (doc_id) WHERE target = 0),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS every FROM e WHERE n >= 20)
SELECT e.doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * every // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
""",
    "op13_prefix_trie": f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id, hex(CAST(conv_id AS VARCHAR)) AS hex FROM t), crc_table),
r AS (SELECT c.conv_id, 0 AS part, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.pos >= c.h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM r),
m AS (SELECT conv_id, depth, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path, text FROM d UNION ALL SELECT conv_id, 0, '', NULL FROM c),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')), 0) AS saved FROM m GROUP BY depth, path),
up AS (SELECT n.conv_id, n.depth, p.conv_id AS parent FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 JOIN n p ON p.depth = m.depth AND p.path = m.path),
k AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n FROM up GROUP BY ALL),
under AS (SELECT v.conv_id, v.depth, w.saved, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf FROM n w LEFT JOIN k USING (conv_id, depth)
  JOIN m ON m.conv_id = w.conv_id AND m.depth <= w.depth JOIN n v ON v.depth = m.depth AND v.path = m.path),
s AS (SELECT conv_id, depth, sum(leaf) AS leaves, sum(saved) AS saved FROM under GROUP BY conv_id, depth),
z AS (SELECT depth, path, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM m JOIN (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id) USING (conv_id, depth) GROUP BY depth, path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.parent AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
sha256(coalesce(ids, '')) AS ends_sha256 FROM n LEFT JOIN up USING (conv_id, depth) LEFT JOIN k ON k.conv_id = n.conv_id AND k.depth = n.depth JOIN s ON s.conv_id = n.conv_id AND s.depth = n.depth LEFT JOIN z ON z.depth = n.depth AND z.path = n.path
""",
}
