"""Image headers from bytes: format by magic, size and pixel format, import checks.

detect() is a Column expression. Headers with variable layout are walked in Arrow
batches; only the first MiB of a file is looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCAN = 1 << 20
#: Field tags of the TIFF directory, and makers whose TIFF containers are raw files.
WIDTH, HEIGHT, BITS, MAKE, SAMPLES, DNG = 256, 257, 258, 271, 277, 50706
MAKERS = {"NIKON": "image/x-nikon-nef", "SONY": "image/x-sony-arw", "Canon": "image/x-canon-cr2"}
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
COLOURS = {0: "gray", 2: "rgb", 3: "palette", 4: "graya", 6: "rgba"}
CHANNELS = {1: "gray", 2: "graya", 3: "rgb", 4: "rgba"}
EXR_TYPES = {0: "uint32", 1: "float16", 2: "float32"}


def detect(content: Column) -> Column:
    """jpeg, png, exr, tiff (container, raw or not) or unknown, by magic bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head == "89504E470D0A1A0A", "png").when(head.startswith("762F3101"), "exr")
        .when((F.length(content) >= 8) & (head.startswith("49492A00") | head.startswith("4D4D002A")), "tiff").otherwise("unknown")
    )


class Corrupt(ValueError):
    """A header that can't be read."""


def _at(fmt: str, data: bytes, off: int):
    try:
        return struct.unpack_from(fmt, data, off)
    except struct.error:
        raise Corrupt(f"header ends before byte {off}") from None


def _jpeg(data: bytes) -> dict:
    """Segments up to the first frame header. Its sizes have 16 bits; a JPEG-LS file (frame FFF7) whose sides are longer has them in a segment FFF8 of type 4 before it, and 0 in the frame."""
    off, long_sides = 2, (0, 0)
    while off + 4 <= len(data):
        if data[off] != 0xFF:
            raise Corrupt("marker expected")
        run = len(data[off:]) - len(data[off:].lstrip(b"\xff"))
        off += run
        if off >= len(data) or data[off] == 0:
            raise Corrupt("marker expected")
        marker, off = data[off], off + 1
        if 0xD0 <= marker <= 0xDA:
            continue  # no length follows
        (size,) = _at(">H", data, off)
        if size < 2:
            raise Corrupt("segment length")
        if marker == 0xF8 and size >= 4 and _at("B", data, off + 2) == (4,):
            (n,) = _at("B", data, off + 3)
            if n not in (2, 3, 4) or size < 4 + 2 * n or off + 4 + 2 * n > len(data):
                raise Corrupt("oversize dimensions")
            long_sides = tuple(int.from_bytes(data[i : i + n], "big") for i in (off + 4, off + 4 + n))
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8) or marker == 0xF7:
            _, depth, height, width, parts = _at(">HBHHB", data, off)
            if marker == 0xF7:
                height, width = height or long_sides[0], width or long_sides[1]
            return {"format": "jpeg", "width": width, "height": height, "pixel_format": {1: "gray", 4: "rgba"}.get(parts, "rgb") + str(depth), "mime_type": "image/jpeg"}
        off += size
    raise Corrupt("no frame header")


def _png(data: bytes) -> dict:
    size, kind, width, height, depth, colour = _at(">I4sIIBB", data, 8)
    if kind != b"IHDR" or size < 13 or len(data) < 29:
        raise Corrupt("no image header chunk")
    name = COLOURS.get(colour)
    return {"format": "png", "width": width, "height": height, "pixel_format": f"{name}{depth}" if name else "unknown", "mime_type": "image/png"}


def _directory(data: bytes) -> tuple[str, Iterator[tuple[int, int, int, bytes]]]:
    """Byte order and the entries (tag, type, count, value bytes) of the first directory."""
    order = "<" if data[:2] == b"II" else ">"
    (first,) = _at(order + "I", data, 4)

    def entries():
        if first + 2 > len(data):
            return
        (n,) = _at(order + "H", data, first)
        for i in range(n):
            off = first + 2 + 12 * i
            if off + 12 > len(data):
                return
            tag, kind, count = _at(order + "HHI", data, off)
            size = FIELD_SIZE.get(kind, 1) * count
            where = off + 8 if size <= 4 else _at(order + "I", data, off + 8)[0]
            yield tag, kind, count, data[where : where + size]

    return order, entries()


def _tiff(data: bytes) -> dict:
    order, entries = _directory(data)
    found = {tag: (kind, raw) for tag, kind, _, raw in entries}

    def number(tag: int, default: int) -> int:
        kind, raw = found.get(tag, (0, b""))
        fmt = {1: "B", 3: "H", 4: "I"}.get(kind)
        return struct.unpack_from(order + fmt, raw)[0] if fmt and len(raw) >= struct.calcsize(fmt) else default

    width, height = number(WIDTH, 0), number(HEIGHT, 0)
    if not width or not height:
        raise Corrupt("no size")
    make = found.get(MAKE, (0, b""))[1].split(b"\0")[0].decode("latin-1")
    mime = next((m for name, m in MAKERS.items() if make.startswith(name)), None)
    mime = "image/x-canon-cr2" if data[8:10] == b"CR" else "image/x-adobe-dng" if DNG in found else mime
    pixel = CHANNELS.get(number(SAMPLES, 1), "rgb") + str(number(BITS, 8))
    return {"format": "raw" if mime else "tiff", "width": width, "height": height, "pixel_format": pixel, "mime_type": mime or "image/tiff"}


def _exr(data: bytes) -> dict:
    def text(off: int) -> tuple[str, int]:
        end = data.find(b"\0", off)
        if end < 0:
            raise Corrupt("string without end")
        return data[off:end].decode("latin-1"), end + 1

    off, box, sample = 8, None, "unknown"
    while off < len(data):
        name, off = text(off)
        if not name:
            break
        kind, off = text(off)
        (size,) = _at("<I", data, off)
        off += 4
        if off + size > len(data):
            raise Corrupt("attribute is cut off")
        if (name, kind) == ("dataWindow", "box2i") and size >= 16:
            box = _at("<4i", data, off)
        elif (name, kind) == ("channels", "chlist") and size > 1 and data[off]:
            end = data.find(b"\0", off, off + size)
            if 0 <= end and end + 5 <= off + size:
                sample = EXR_TYPES.get(_at("<I", data, end + 1)[0], "unknown")
        off += size
    if not box or box[2] < box[0] or box[3] < box[1]:
        raise Corrupt("no data window")
    return {"format": "exr", "width": box[2] - box[0] + 1, "height": box[3] - box[1] + 1, "pixel_format": sample, "mime_type": "image/x-exr"}


def parse_header(data: bytes | None) -> dict | None:
    """format, width, height, pixel_format, mime_type; None if unknown or unreadable."""
    data = (data or b"")[:SCAN]
    if data.startswith(b"\xff\xd8\xff"):
        parse = _jpeg
    elif data.startswith(b"\x89PNG\r\n\x1a\n"):
        parse = _png
    elif data.startswith(b"\x76\x2f\x31\x01"):
        parse = _exr
    elif len(data) >= 8 and data[:4] in (b"II*\0", b"MM\0*"):
        parse = _tiff
    else:
        return None
    try:
        return parse(data)
    except (Corrupt, struct.error):
        return None


def with_headers(files: DataFrame) -> DataFrame:
    """files(path, content, ...) with a nullable struct `header` instead of content's bytes."""
    kind = pa.struct([("format", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("pixel_format", pa.string()), ("mime_type", pa.string())])

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index("__head")).to_pylist()
            rest = [(n, b.column(i)) for i, n in enumerate(b.schema.names) if n != "__head"]
            yield pa.record_batch([c for _, c in rest] + [pa.array(map(parse_header, col), kind)], [n for n, _ in rest] + ["header"])

    kept = [c for c in files.columns if c != "content"]
    slim = files.select(*kept, F.col("content").substr(1, SCAN).alias("__head"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*kept).schema)
    return slim.mapInArrow(run, f"{fields}, header struct<format:string,width:bigint,height:bigint,pixel_format:string,mime_type:string>")


def png_header(content: Column) -> Column:
    """Struct of a PNG's header as plain expressions: its fields stand at fixed places; null if it is no PNG or its header is cut off."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("long")
    ok = (detect(content) == "png") & (F.hex(F.substring(content, 13, 4)) == "49484452") & (number(9, 4) >= 13) & (F.length(content) >= 29)
    name = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])[number(26, 1).cast("int")]
    pixel = F.coalesce(F.concat(name, number(25, 1).cast("string")), F.lit("unknown"))
    return F.when(ok, F.struct(F.lit("png").alias("format"), number(17, 4).alias("width"), number(21, 4).alias("height"), pixel.alias("pixel_format"), F.lit("image/png").alias("mime_type")))


def import_reason(content: Column, header: Column, sensor_id: Column, timestamp_ns: Column) -> Column:
    """The one error code of a file, null if it can be imported; the order of the checks decides."""
    return (
        F.when(content.isNull(), "Unreadable").when(detect(content) == "unknown", "UnsupportedFormat").when(header.isNull(), "Corrupt")
        .when(sensor_id.isNull(), "SensorUnresolved").when(F.coalesce(timestamp_ns, F.lit(0)) == 0, "TimestampUnresolvable")
    )
