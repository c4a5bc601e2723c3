"""Web archives (WARC 1.1) in Zstandard: one frame a record, the dictionary in a leading skippable frame.

An archive is one value of bytes, as a file .warc.zst holds them: a skippable frame with
the dictionary (itself a Zstandard frame, or plain), then a frame for each record. The
reader walks the headers of frames and blocks to find where each frame ends, before it decodes
anything, so records can be read one by one and a damaged frame is told by its place.

Writing. Payloads are compared by SHA-1 and length, in a narrow table (digest, count, largest
id) that is aggregated before it is shuffled. Only rows whose payload occurs twice or more are joined with it;
all others go straight to their archive. Of equal payloads of at least `least` bytes, the record
with the largest page_id is the response; all others are revisits (profile identical-payload-digest), which hold the
HTTP header, the digest and the id of that response, but no payload. Each task packs its rows into archives
of about `archive_bytes`; a larger page has an archive of its own. The dictionary is trained on at most `sample`
pages, of which it sees the first 8 KB each; too few or too uniform pages give archives without one. It changes sizes, never what is read back.

Reading. Each record is decoded alone and checked: magic numbers, block types, declared and true
length of the frame, its checksum, the WARC version line, the headers that every record must have, Content-Length
against the bytes there are, the closing line breaks, block and payload digests. A record that fails is a row with `error`, all
else null; after a frame whose end can't be found, the rest of that archive is one such row. check_revisits tells
revisits whose response is missing or differs; revisits are grouped before that join.

A null html is an empty payload. Empty payloads are payloads like others. Rows that repeat an id with the
same payload as the response are responses too. A null page_id is smaller than any other and can't be referred to: where
all ids of a payload are null, all are responses. A null url is urn:page:<id>; control characters and
spaces in urls are percent-encoded. Empty tables give no archive and no row. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, small_batches, split_by

# Fixed values of the formats: magic numbers of a frame, of skippable frames and of the one that holds a dictionary; field sizes by flag.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
ID_BYTES, SIZE_BYTES = (0, 1, 2, 4), (0, 2, 4, 8)
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")

URN = "urn:page:"
MOST = 1 << 30


class WarcError(ValueError):
    pass


def frame(data: memoryview, at: int) -> tuple[int, int, int | None]:
    """(magic number, place after the frame, size of its content as declared) of the frame that starts at `at`."""
    whole = len(data)

    def number(i: int, n: int) -> int:
        if i + n > whole:
            raise WarcError("truncated frame")
        return int.from_bytes(data[i : i + n], "little")

    magic = number(at, 4)
    if magic & ~0xF == SKIPPABLE:
        size = number(at + 4, 4)
        end = at + 8 + size
        if end > whole:
            raise WarcError("truncated skippable frame")
        return magic, end, size
    if magic != FRAME:
        raise WarcError("no frame")
    flags = number(at + 4, 1)
    if flags & 8:
        raise WarcError("reserved bit of a frame header")
    single = flags >> 5 & 1
    i = at + 5 + (1 - single) + ID_BYTES[flags & 3]
    n = SIZE_BYTES[flags >> 6] or single
    size = number(i, n) + 256 * (n == 2) if n else None
    i, last = i + n, 0
    while not last:
        head = number(i, 3)
        last, kind, length = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError("reserved block type")
        i += 3 + (1 if kind == 1 else length)  # a block of one repeated byte stores that byte
    i += 4 * (flags >> 2 & 1)
    if i > whole:
        raise WarcError("truncated frame")
    return magic, i, size


def dictionary(data: memoryview) -> tuple[object | None, int]:
    """The dictionary of an archive, None if it has none, and where its first record starts."""
    import zstandard

    if len(data) < 4 or int.from_bytes(data[:4], "little") != DICTIONARY:
        return None, 0
    _, end, _ = frame(data, 0)
    raw = bytes(data[8:end])
    if raw[:4] == FRAME.to_bytes(4, "little"):
        _, stop, size = frame(memoryview(raw), 0)
        if stop != len(raw):
            raise WarcError("bytes after the dictionary")
        raw = decoded(zstandard.ZstdDecompressor(), memoryview(raw), size)
    return zstandard.ZstdCompressionDict(raw), end


def decoded(decompressor, data: memoryview, size: int | None, most: int = MOST) -> bytes:
    """The content of one frame, of the declared size where that is known, of at most `most` bytes."""
    import zstandard

    if size is not None and size > most:
        raise WarcError("record too large")
    try:
        if size is not None:
            out = decompressor.decompress(data, max_output_size=size) if size else decompressor.decompressobj().decompress(data)
        else:
            job, parts, have = decompressor.decompressobj(), [], 0
            for i in range(0, len(data), 1 << 14):
                parts.append(job.decompress(data[i : i + (1 << 14)]))
                have += len(parts[-1])
                if have > most:
                    raise WarcError("record too large")
            out = b"".join(parts)
            if not job.eof:
                raise WarcError("frame without an end")
    except zstandard.ZstdError as e:
        raise WarcError(f"frame: {e}") from e
    if size is not None and len(out) != size:
        raise WarcError("frame size")
    return out


def fields(head: bytes) -> dict[str, str]:
    """Headers by lower-case name; a line that starts with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.split(b"\r\n"):
        if line[:1] in b" \t" and line and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon or not key or key != key.strip():
            raise WarcError("header line")
        name = key.decode("utf-8", "replace").lower()
        out.setdefault(name, value.strip().decode("utf-8", "replace"))
    return out


def whole_number(text: str | None, what: str) -> int:
    if text is None or not re.fullmatch("[0-9]{1,18}", text):
        raise WarcError(what)
    return int(text)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_of(record_id: str | None) -> int | None:
    found = re.fullmatch(rf"<{URN}(-?[0-9]+)>", record_id or "")
    return int(found[1]) if found else None


def parsed(record: bytes) -> dict:
    """One record, checked: its headers, what its HTTP header says, and its payload."""
    start = record.split(b"\r\n", 1)[0]
    if start not in VERSIONS:
        raise WarcError("version line")
    stop = record.find(b"\r\n\r\n")
    if stop < 0:
        raise WarcError("header has no end")
    head = fields(record[len(start) + 2 : stop]) if stop > len(start) else {}
    for name in NEEDED:
        if name not in head:
            raise WarcError(f"no {name}")
    block = record[stop + 4 :]
    n = whole_number(head["content-length"], "content-length")
    if len(block) != n + 4:
        raise WarcError("length of the block")
    if block[n:] != b"\r\n\r\n":
        raise WarcError("end of the record")
    block = block[:n]
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{digest(block)}":
        raise WarcError("block digest")
    kind, payload, size = head["warc-type"], b"", None
    if head.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        first, _, rest = http.partition(b"\r\n")
        if not gap or not first.startswith(b"HTTP/"):
            raise WarcError("HTTP header")
        length = fields(rest).get("content-length") if rest else None
        size = whole_number(length, "HTTP content-length") if length is not None else None
    else:
        payload = block
    sum_ = head.get("warc-payload-digest", "")
    if kind == "response":
        if size is not None and size != len(payload):
            raise WarcError("length of the payload")
        if sum_ and sum_ != f"sha1:{digest(payload)}":
            raise WarcError("payload digest")
        size = len(payload)
    elif kind == "revisit" and (payload or not sum_ or not head.get("warc-refers-to")):
        raise WarcError("revisit")
    return {
        "record_type": kind, "record_id": head["warc-record-id"], "target_uri": head.get("warc-target-uri"), "page_id": page_of(head["warc-record-id"]),
        "refers_to": page_of(head.get("warc-refers-to")), "payload_digest": sum_.removeprefix("sha1:") or None, "payload_bytes": size, "payload": payload if kind == "response" else None, "error": None,
    }


def records(data: bytes, most: int = MOST) -> Iterator[tuple[int, dict]]:
    """(place in the archive, record) of every record of one archive; what fails has only `error`."""
    import zstandard

    view, at = memoryview(data), 0
    try:
        known, at = dictionary(view)
        decompressor = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
        while at < len(view):
            magic, end, size = frame(view, at)
            if magic == FRAME:
                try:
                    yield at, parsed(decoded(decompressor, view[at:end], size, most))
                except WarcError as e:
                    yield at, {"error": str(e)}
            at = end
    except WarcError as e:
        yield at, {"error": str(e)}


_COLUMNS = {
    "archive": "string", "offset": "long", "record_type": "string", "record_id": "string", "target_uri": "string", "page_id": "long", "refers_to": "long",
    "payload_digest": "string", "payload_bytes": "long", "payload": "binary", "error": "string",
}
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def read_archives(archives: DataFrame, payloads: bool = True, most: int = MOST, batch_bytes: int = 16 << 20) -> DataFrame:
    """A row a record of archives(archive, content): also of files, by spark.read.format("binaryFile") with path as archive.
    payloads: whether to return them; they are checked either way."""
    small_batches(archives.sparkSession)
    names = [c for c in _COLUMNS if payloads or c != "payload"]

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r.get(c) for r in found], _ARROW[_COLUMNS[c]]) for c in names], names)

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                found, held = [], 0
                for at, r in records(content.as_py() or b"", most):
                    found.append(r | {"archive": name.as_py(), "offset": at})
                    held += len(r.get("payload") or b"") * payloads + 200
                    if held > batch_bytes:
                        yield rows(found)
                        found, held = [], 0
                if found:
                    yield rows(found)

    kinds = ", ".join(f"{c} {_COLUMNS[c]}" for c in names)
    return archives.select(F.col("archive").cast("string"), F.col("content").cast("binary")).mapInArrow(run, kinds)


def check_revisits(rows: DataFrame) -> DataFrame:
    """rows of read_archives, with the error 'dangling revisit' where no response has the id, digest and length that a revisit
    names. Revisits are grouped by these first: of a page that a third of all rows revisit, one row is joined."""
    key = ["refers_to", "payload_digest", "payload_bytes"]
    asked = rows.where("record_type = 'revisit'").select(*key).distinct()
    there = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *key[1:])
    bad = asked.join(there, key, "left_anti").select(*[F.col(c).alias(f"__{c}") for c in key])
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    marked = rows.join(bad.withColumn("__bad", F.lit(True)), same & (F.col("record_type") == "revisit"), "left")
    return marked.withColumn("error", F.coalesce("error", F.when(F.col("__bad"), "dangling revisit"))).select(*rows.columns)


def train(pages: DataFrame, sample: int, size: int) -> bytes | None:
    """A dictionary of at most `size` bytes, trained on the heads of at most `sample` pages."""
    import zstandard

    heads = pages.where("length(html) > 0").select(F.substring("html", 1, 8192).alias("h")).limit(sample).toArrow()["h"]
    try:
        return zstandard.train_dictionary(size, [h.as_py().encode() for h in heads]).as_bytes() if len(heads) >= 8 else None
    except zstandard.ZstdError:
        return None


def record(kind: str, page_id: int | None, url: str | None, sha1: str, size: int, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The bytes of one response or revisit."""
    here = f"{URN}{page_id if page_id is not None else 'null'}"
    uri = re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else here
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{here}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _pack(trained: bytes | None, archive_bytes: int, level: int, date: str, run_id: str):
    def run(batches):
        import zstandard

        lead = b""
        compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        if trained:
            stored = compressor.compress(trained)
            lead = DICTIONARY.to_bytes(4, "little") + len(stored).to_bytes(4, "little") + stored
            known = zstandard.ZstdCompressionDict(trained)
            known.precompute_compress(level=level)
            compressor = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        part, n = TaskContext.get().partitionId(), 0

        def info() -> bytes:
            block = b"software: karstline\r\nformat: WARC File Format 1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{run_id}-{part}-{n}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
            return compressor.compress(head.encode() + block + b"\r\n\r\n")

        def closed():
            return pa.record_batch([pa.array([f"{run_id}-{part:05d}-{n:05d}.warc.zst"]), pa.array([b"".join(held)], pa.binary())], ["archive", "content"])

        held, size = [lead], 0
        for b in batches:
            col = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "html", "sha1", "size", "refers_to")]
            for cell in zip(*col):
                page_id, url, html, sha1, length, refers_to = (c.as_py() for c in cell)
                kind = "response" if refers_to is None else "revisit"
                payload = (html or "").encode() if refers_to is None else b""
                piece = compressor.compress(record(kind, page_id, url, sha1, length, payload, refers_to, date))
                if len(held) > 1 and size + len(piece) > archive_bytes:
                    yield closed()
                    held, size, n = [lead], 0, n + 1
                if len(held) == 1:
                    held.append(info())
                held.append(piece)
                size += len(piece)
        if len(held) > 1:
            yield closed()

    return run


def write_archives(
    pages: DataFrame, least: int = 0, archive_bytes: int = 4 << 20, level: int = 3, sample: int = 500, dict_bytes: int = 32_768,
    date: str = "2024-01-01T00:00:00Z", name: str = "pages",
) -> DataFrame:
    """archive, content: archives of pages(page_id, url, html), written to the shared folder."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    pages = pages.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    counted = pages.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("top"))
    again = cut(counted.where("n > 1 and top is not null").select("sha1", "size", "top"), "copies")
    some, rest = split_by(pages, "sha1", again.select("sha1"))
    some = some.join(again, ["sha1", "size"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")), F.col("top"))
    some = some.withColumn("refers_to", refers).withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    every = rest.withColumn("refers_to", F.lit(None).cast("long")).unionByName(some.select(*rest.columns, "refers_to"))
    out = cut(every.mapInArrow(_pack(train(pages, sample, dict_bytes), archive_bytes, level, date, name), "archive string, content binary"), "warc")
    drop_cut(again)
    return out


def save_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file of its name to a folder (an address that pyarrow.fs knows) that all executors share; returns
    archive, bytes. A file is renamed once it is whole, so a task that runs again leaves the same files."""

    def run(batches):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                with where.open_output_stream(f"{path}/.{name}.{attempt}") as f:
                    f.write(content.as_py())
                where.move(f"{path}/.{name}.{attempt}", f"{path}/{name}")
                yield pa.record_batch([pa.array([name]), pa.array([len(content.as_py())], pa.int64())], ["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, bytes long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, error of every page, read back from archives of them."""
    rows = read_archives(write_archives(pages, least), payloads=False)
    rows = cut(rows.where("error is not null or record_type <> 'warcinfo'"), "records")
    return check_revisits(rows).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "error")
