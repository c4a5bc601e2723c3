"""op11: archives built by hand, damaged archives, round trips, copies, odd tables."""

import base64
import collections
import hashlib

import oracle
import pytest
import zstandard
from pyspark.sql import functions as F

from karstline.llm import queries, warc_zst

D = "/root/testdata/sf0.001"
b32 = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()


def by_hand(payload=b"<p>hi</p>", cut=0, **change):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:page:7>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response", "WARC-Target-URI": "http://x/", "Content-Length": str(len(block)), "WARC-Payload-Digest": "sha1:" + b32(payload)}
    head |= {k.replace("_", "-"): v for k, v in change.items()}
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items() if v is not None)
    whole = b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"
    return whole[: len(whole) - cut]


def skippable(data, magic=0x184D2A5D):
    return magic.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data


def read(data):
    return [r for _, r in warc_zst.records(data)]


SAMPLES = [(f"<html><head><title>{i}</title></head><body>some words {i * 7919 % 997} and {i} more</body></html>" * 3).encode() for i in range(400)]


def test_hand_made_archives():
    plain = zstandard.ZstdCompressor(write_content_size=True, write_checksum=True)
    sizeless = zstandard.ZstdCompressor(write_content_size=False)
    trained = zstandard.train_dictionary(4096, SAMPLES)
    with_dict = zstandard.ZstdCompressor(dict_data=trained)
    a = by_hand()
    # without a dictionary; sizes declared or not; skippable frames in between; runs of one byte and many blocks in a frame
    big = by_hand(b"a" * 1_000_000 + bytes(range(256)) * 3000)
    got = read(plain.compress(a) + skippable(b"noise", 0x184D2A53) + sizeless.compress(a) + plain.compress(big) + sizeless.compress(big))
    assert [r["error"] for r in got] == [None] * 4 and [r["payload_bytes"] for r in got] == [9, 9, 1_768_000, 1_768_000]
    assert got[0]["payload"] == b"<p>hi</p>" and got[0]["page_id"] == 7 and got[0]["payload_digest"] == b32(b"<p>hi</p>")
    # the dictionary stored plainly, and as a frame of its own
    for stored in (trained.as_bytes(), plain.compress(trained.as_bytes())):
        assert [r["payload"] for r in read(skippable(stored) + with_dict.compress(a) * 2)] == [b"<p>hi</p>"] * 2
    # without its dictionary a frame can't be decoded
    assert "error" in read(with_dict.compress(a))[0] and read(with_dict.compress(a))[0]["error"]
    assert read(b"") == [] and read(skippable(plain.compress(trained.as_bytes()))) == []


def test_damage_is_told_and_the_rest_is_read():
    c = zstandard.ZstdCompressor(write_checksum=True).compress
    good = c(by_hand())
    wrong = {
        "version line": by_hand().replace(b"WARC/1.1", b"WARC/9.1"), "length of the block": by_hand(cut=1), "content-length": by_hand(Content_Length="x"),
        "no warc-date": by_hand(WARC_Date=None), "payload digest": by_hand(WARC_Payload_Digest="sha1:AAAA"), "block digest": by_hand(WARC_Block_Digest="sha1:AAAA"),
        "revisit": by_hand(WARC_Type="revisit"), "header line": by_hand().replace(b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Date 2024"), "header has no end": b"WARC/1.1\r\nx: y",
        "end of the record": by_hand()[:-4] + b"\r\n\n\r", "length of the payload": by_hand().replace(b"Content-Length: 9", b"Content-Length: 8"),
    }
    for error, record in wrong.items():
        got = read(good + c(record) + good)
        assert [r["error"] for r in got] == [None, error, None], error
    flipped = bytearray(good)
    flipped[-1] ^= 1  # of the checksum
    got = read(good + bytes(flipped) + good)
    assert [bool(r["error"]) for r in got] == [False, True, False] and got[1]["error"].startswith("frame")
    for n in range(1, len(good)):
        got = read(good + good[:n])
        assert len(got) == 2 and got[0]["error"] is None and got[1]["error"]
    assert [r["error"] for r in read(good + b"junk")] == [None, "no frame"]
    assert read(good + c(by_hand(b"x" * 5000)))[1]["error"] is None
    assert [r["error"] for _, r in warc_zst.records(c(by_hand(b"x" * 5000)), most=4000)] == ["record too large"]


ODD = [
    (1, "http://a/é b\r\n", "copy", 1), (2, None, "copy", 1), (9, "u", "copy", 1), (9, "v", "copy", 1), (None, "w", "copy", 1), (3, "u", None, 1), (4, "u", "", 1),
    (5, "u", "long " * 400_000, 1), (6, "u", "alone é😀", 1), (7, "u", "none", 1), (None, "q", "nobody", 1), (None, "r", "nobody", 1),
]


def plain(rows, least):
    out = collections.Counter()
    for i, _, html, *_ in rows:
        p = (html or "").encode()
        same = [j for j, _, h, *_ in rows if (h or "") == (html or "") and j is not None]
        top = max(same, default=None) if len(p) >= least else None
        refers = top if top is not None and (i is None or i < top) else None
        out[i, len(p), b32(p), "response" if refers is None else "revisit", refers] += 1
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_odd_rows(spark, least):
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string, sha1 int")
    got = warc_zst.round_trip(pages, least).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == plain(ODD, least) and not any(r.error for r in got)
    uris = {r.page_id: r.target_uri for r in got}
    assert uris[1] == "http://a/é%20b%0D%0A" and uris[2] == "urn:page:2"
    assert warc_zst.round_trip(pages.limit(0)).collect() == []


def test_hot_copies(spark):
    """A third of the rows hold one payload; archives are small, so there are many."""
    rows = [(i, "u", "hot " * 50 if i % 3 == 0 else f"page {i} " * 40) for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc_zst.write_archives(pages, archive_bytes=2000)
    assert archives.count() > 20 and archives.selectExpr("substring(content, 1, 4) AS m").distinct().collect()[0].m == bytes.fromhex("5d2a4d18")
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_zst.read_archives(archives, payloads=False).where("record_type <> 'warcinfo'").collect())
    assert got == plain(rows, 0)


def test_files(spark, tmp_path):
    """Archives as files, read by Spark's own reader of files, with one of them damaged and a response taken away."""
    pages = spark.read.parquet(f"{D}/pages.parquet")
    pages = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1000))
    archives = warc_zst.write_archives(pages, archive_bytes=60_000)
    saved = warc_zst.save_files(archives, f"file://{tmp_path}/warc").collect()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{tmp_path}/warc")
    back = warc_zst.read_archives(files.select(F.col("path").alias("archive"), "content")).where("record_type <> 'warcinfo'")
    want = {(r.page_id, r.html) for r in pages.where("page_id >= 1000").collect()}
    assert len(saved) == files.count() and {(r.page_id, bytes(r.payload).decode()) for r in back.where("record_type = 'response'").collect()} == want
    assert warc_zst.check_revisits(back).where("error is not null").count() == 0
    lost = warc_zst.check_revisits(back.where("page_id <> 1003 or record_type <> 'response'")).where("error is not null").collect()
    assert [(r.page_id, r.error) for r in lost] == [(3, "dangling revisit")]


def test_query(spark):
    assert oracle.compare(spark, queries.QUERIES["op11_warc_zst"], queries.ORACLE["op11_warc_zst"], D) > 0
