"""Carriers: PNG chunks, WebP chunks and JPEG segments, and the box that holds a text layer in each.

Readers are total: malformed bytes give nothing, never an error. Byte work runs in Arrow
functions; what can be said in columns (sniffing, box building, caps) is.
"""

from __future__ import annotations

import json
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import formats as K

PARTS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("crc", T.LongType())]))
GLOB = "*.{png,jpg,jpeg,webp,PNG,JPG,JPEG,WEBP}"


# --- columns ---


def detect(content: Column) -> Column:
    """png, jpeg, webp, or null."""
    at = lambda pos, n: F.substring(content, pos, n)
    return (
        F.when(at(1, 8) == F.lit(K.PNG_SIGNATURE), "png")
        .when(at(1, 3) == F.lit(b"\xff\xd8\xff"), "jpeg")
        .when((at(1, 4) == F.lit(b"RIFF")) & (at(9, 4) == F.lit(b"WEBP")), "webp")
    )


def mime(fmt: Column) -> Column:
    return F.when(fmt.isNotNull(), F.concat(F.lit("image/"), fmt))


def big_endian(n: Column) -> Column:
    """A whole number as 4 bytes."""
    return F.unhex(F.lpad(F.hex(n), 8, "0"))


def boxed(layer_json: Column) -> Column:
    """The box around a layer's JSON: description with type and label, then the JSON itself."""
    body = F.encode(layer_json, "UTF-8")
    about = b"jumb" + K.BOX_UUID + b"\x03" + K.BOX_LABEL
    about = struct.pack(">I", len(about) + 4) + about
    n = F.octet_length(body)
    return F.concat(big_endian(n + 16 + len(about)), F.lit(b"jumb" + about), big_endian(n + 8), F.lit(b"json"), body)


# --- bytes ---


def scan(data: bytes | None, cap: int = K.PAYLOAD_CAP) -> list[tuple[str, int, int, int | None]]:
    """(type, offset of the payload, its length, stored checksum) of each part; ends at the first that is too long or cut off."""
    out: list[tuple[str, int, int, int | None]] = []
    if data is None:
        return out
    n = len(data)
    if data[:8] == K.PNG_SIGNATURE:
        at = 8
        while at + 12 <= n:
            (size,) = struct.unpack_from(">I", data, at)
            if size > cap or at + 12 + size > n:
                break
            out.append((data[at + 4 : at + 8].decode("latin-1"), at + 8, size, struct.unpack_from(">I", data, at + 8 + size)[0]))
            at += 12 + size
            if out[-1][0] == "IEND":
                break
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= n:
            (size,) = struct.unpack_from("<I", data, at + 4)
            if size > cap or at + 8 + size > n:
                break
            out.append((data[at : at + 4].decode("latin-1"), at + 8, size, None))
            at += 8 + size + size % 2
    elif data[:2] == b"\xff\xd8":
        at = 2
        while at + 2 <= n and data[at] == 0xFF:
            mark = data[at + 1]
            if mark == 0xFF:  # fill
                at += 1
            elif mark == 0xD8 or 0xD0 <= mark <= 0xD7:
                at += 2
            elif mark in (0xDA, 0xD9):
                out.append((f"{mark:02X}", at + 2, 0, None))
                break
            else:
                size = struct.unpack_from(">H", data, at + 2)[0] if at + 4 <= n else 0
                if size < 2 or at + 2 + size > n:
                    break
                out.append((f"{mark:02X}", at + 4, size - 2, None))
                at += 2 + size
    return out


def box_of(data: bytes | None) -> bytes | None:
    """The first layer box of a carrier."""
    for kind, at, size, _ in scan(data):
        part = data[at : at + size]
        if kind in (K.PNG_CHUNK.decode(), K.WEBP_CHUNK.decode()):
            return part
        if kind == "EB" and part[:4] == K.JPEG_IDENT and len(part) > 8:
            return part[8:]
    return None


def layer_of(box: bytes | None) -> str | None:
    """The JSON in a box: the last JSON child counts; the description's type must be ours."""
    if box is None or len(box) < 8 or box[4:8] != b"jumb":
        return None
    end = struct.unpack_from(">I", box)[0]
    if not 8 <= end <= len(box):
        return None
    at, found, described = 8, None, False
    while at + 8 <= end:
        (size,) = struct.unpack_from(">I", box, at)
        if size < 8 or at + size > end:
            return None
        kind, body = box[at + 4 : at + 8], box[at + 8 : at + size]
        if kind == b"jumb" and not described:
            described = body[:16] == K.BOX_UUID
            if not described:
                return None
        elif kind == b"json":
            if len(body) > K.PAYLOAD_CAP:
                return None
            found = body
        at += size
    if not described or found is None:
        return None
    try:
        text = found.decode("utf-8")
        json.loads(text)
        return text
    except ValueError:
        return None


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def inject(data: bytes, box: bytes) -> tuple[bytes | None, str]:
    """The carrier with the box in it, and a status: PNG before its end, JPEG before the scan, WebP at the end."""
    parts = scan(data)
    if data[:8] == K.PNG_SIGNATURE:
        if not parts or parts[-1][0] != "IEND":
            return None, "no end chunk"
        at = parts[-1][1] - 8
        return data[:at] + png_chunk(K.PNG_CHUNK, box) + data[at:], "ok"
    if data[:2] == b"\xff\xd8":
        body = K.JPEG_IDENT + b"\x00\x00\x00\x01" + box
        if len(body) + 2 > K.SEGMENT_CAP:
            return None, K.TOO_LONG
        if not parts or parts[-1][0] not in ("DA", "D9"):
            return None, "no scan"
        at = parts[-1][1] - 2
        return data[:at] + b"\xff\xeb" + struct.pack(">H", len(body) + 2) + body + data[at:], "ok"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and parts:
        kind, at, size, _ = parts[0]
        head = b""
        if kind in ("VP8 ", "VP8L"):
            w, h = webp_size(kind, data[at : at + size])
            head = b"VP8X" + struct.pack("<I", 10) + bytes(4) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
        body = b"WEBP" + head + data[12:] + b"\x00" * (len(data) % 2) + K.WEBP_CHUNK + struct.pack("<I", len(box)) + box + b"\x00" * (len(box) % 2)
        return b"RIFF" + struct.pack("<I", len(body)) + body, "ok"
    return None, "unknown format"


def webp_size(kind: str, frame: bytes) -> tuple[int, int]:
    """Width and height from a VP8 or VP8L frame header; 1 by 1 if it is cut off."""
    if kind == "VP8L" and len(frame) >= 5 and frame[0] == 0x2F:
        bits = int.from_bytes(frame[1:5], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == "VP8 " and len(frame) >= 10:
        w, h = struct.unpack_from("<HH", frame, 6)
        return max(1, w & 0x3FFF), max(1, h & 0x3FFF)
    return 1, 1


def preserved(source: bytes | None, output: bytes | None) -> bytes | None:
    """The output with the source's layer; the output as it is if there is none, it has one, or a reader couldn't read the result."""
    box = box_of(source)
    if output is None or box is None or box_of(output) is not None:
        return output
    out, _ = inject(output, box)
    return out if out is not None and layer_of(box_of(out)) is not None else output


def without_layer(data: bytes | None) -> bytes | None:
    """A carrier without its layers' chunks or segments; anything else as it is."""
    cuts = []
    for kind, at, size, _ in scan(data):
        if kind == K.PNG_CHUNK.decode() and data[:8] == K.PNG_SIGNATURE:
            cuts.append((at - 8, at + size + 4))
        elif kind == K.WEBP_CHUNK.decode() and data[:4] == b"RIFF":
            cuts.append((at - 8, at + size + size % 2))
        elif kind == "EB" and data[at : at + 4] == K.JPEG_IDENT:
            cuts.append((at - 4, at + size))
    for a, b in reversed(cuts):
        data = data[:a] + data[b:]
    return data[:4] + struct.pack("<I", len(data) - 8) + data[8:] if cuts and data[:4] == b"RIFF" else data


# --- tables ---


def is_layer(part: Column) -> Column:
    """Whether a part is of the kind that holds a layer."""
    return part["type"].isin(K.PNG_CHUNK.decode(), K.WEBP_CHUNK.decode(), "EB")


def inspected(carriers: DataFrame) -> DataFrame:
    """Carriers with their layer's JSON, and a code: 0, or 1 where there is none to show."""
    rows = extract(carriers)
    return rows.withColumn("code", F.when(F.col("layer").isNull(), 1).otherwise(0))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Image files below a folder: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(path)


def definitions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


@F.pandas_udf(PARTS)
def part_list(content: pd.Series) -> pd.Series:
    return content.map(lambda b: [dict(zip(("type", "offset", "length", "crc"), p)) for p in scan(b)])


@F.pandas_udf(T.BinaryType())
def raw_box(content: pd.Series) -> pd.Series:
    return content.map(box_of)


@F.pandas_udf(T.BinaryType())
def stripped(content: pd.Series) -> pd.Series:
    return content.map(without_layer)


@F.pandas_udf(T.StringType())
def layer_json(content: pd.Series) -> pd.Series:
    return content.map(lambda b: layer_of(box_of(b)))


@F.pandas_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("status", T.StringType())]))
def injected(content: pd.Series, box: pd.Series) -> pd.DataFrame:
    rows = [inject(c, b) if c is not None and b is not None else (c, "nothing to do") for c, b in zip(content, box)]
    return pd.DataFrame(rows, columns=["content", "status"])


@F.pandas_udf(T.BinaryType())
def kept(source: pd.Series, output: pd.Series) -> pd.Series:
    return pd.Series([preserved(a, b) for a, b in zip(source, output)])


def parts(carriers: DataFrame, keep: str = "path") -> DataFrame:
    """A row for each chunk or segment."""
    return carriers.select(keep, F.explode(part_list("content")).alias("p")).select(keep, "p.*")


def extract(carriers: DataFrame) -> DataFrame:
    """Carriers with fmt, mime and layer (its JSON, or null)."""
    return carriers.withColumn("fmt", detect(F.col("content"))).withColumn("mime", mime(F.col("fmt"))).withColumn("layer", layer_json("content"))


def write(carriers: DataFrame) -> DataFrame:
    """carriers(content, layer) with the layer embedded, and a status instead of an error."""
    return carriers.withColumn("_i", injected("content", boxed(F.col("layer")))).withColumn("content", F.coalesce("_i.content", "content")).withColumn("status", F.col("_i.status")).drop("_i")


def preserve(sources: DataFrame, outputs: DataFrame, key: str = "image_id") -> DataFrame:
    """Re-encoded outputs with the layers of their sources."""
    both = outputs.join(sources.select(key, F.col("content").alias("_source")), key, "left")
    return both.withColumn("content", kept("_source", "content")).drop("_source")


def export(carriers: DataFrame, folder: str) -> DataFrame:
    """Writes each carrier's bytes as one file below ``folder``, which all executors must share; gives path and bytes."""

    def run(frames):
        import os

        for pdf in frames:
            names = []
            for path, content in zip(pdf["path"], pdf["content"]):
                at = os.path.join(folder, f"{zlib.crc32(path.encode()):08x}-{os.path.basename(path)}")  # equal names from other folders
                with open(at, "wb") as f:
                    f.write(content)
                names.append((at, len(content)))
            yield pd.DataFrame(names, columns=["path", "bytes"])

    return carriers.select("path", "content").mapInPandas(run, "path string, bytes long")


def links(pages: DataFrame, ending: str = r"\.(?:png|jpe?g|webp)") -> DataFrame:
    """pages(page_id, html) to the image links in them, or to those of another ending."""
    found = F.regexp_extract_all("html", F.lit(r"""(?:src|href)\s*=\s*["']([^"'>]+""" + ending + r""")["']"""), 1)
    return pages.select("page_id", F.explode(found).alias("link"))
