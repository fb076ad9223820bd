"""Media columns: interleaved document sequences.

A page's HTML is parsed into an ordered sequence of structs: text runs, and references to
media that are named by the SHA-256 digest of their payload and carry a caption. A digest
join resolves the references against a store of media; positions and captions stay as the
page gave them. A payload is stored as an 8-bit RGB PNG of 64 pixels a row (192 bytes a row),
which is read back and checked before anything is computed from it.

Defined cases: null html gives no parts, null text counts as empty; a reference that no
medium answers keeps its place with null media; equal payloads are one medium; a damaged
store entry raises, since a payload that can't be read back is lost; other columns of the
inputs are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, matched, materialise

ROW = 192
PNG = b"\x89PNG\r\n\x1a\n"
FIELDS = ["position", "kind", "text", "digest", "caption"]
PARTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
HOT = 1 << 13  # descriptions that are sent to all tasks, at most
STORED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Parts(HTMLParser):
    """Text runs and media references in page order. A figure's caption belongs to the reference in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.run, self.caption, self.skip, self.figure = [], [], None, 0, None

    def close_run(self):
        text = " ".join("".join(self.run).split())
        if text:
            self.parts.append(["text", text, None, None])
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("img", "video", "audio", "source"):
            src = dict(attrs).get("src") or ""
            if src.startswith("sha256:"):
                self.close_run()
                self.figure = len(self.parts)
                self.parts.append(["media", None, src[7:], dict(attrs).get("alt")])
        elif tag == "figcaption":
            self.close_run()
            self.caption = []
        elif tag in ("p", "div", "article", "section", "li", "h1", "h2", "h3", "figure", "br"):
            self.close_run()
            self.figure = None if tag == "figure" else self.figure

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if self.figure is not None:
                self.parts[self.figure][3] = text
        elif tag in ("p", "div", "article", "section", "li", "h1", "h2", "h3", "figure"):
            self.close_run()

    def handle_data(self, data):
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[list]:
    """[kind, text, digest, caption] of each part of a page, in order."""
    p = _Parts()
    p.feed(page or "")
    p.close()
    p.close_run()
    return p.parts


def sequences(pages: DataFrame, keep: list[str]) -> DataFrame:
    """pages(html, ...) to the columns ``keep`` and parts, the page's ordered structs."""

    def run(frames):
        for pdf in batches(frames, 1 << 22, "html"):
            out = pdf[keep].copy()
            out["parts"] = [[dict(zip(FIELDS, (k, *part))) for k, part in enumerate(parse(page))] for page in pdf["html"]]
            yield out

    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("parts", T._parse_datatype_string(PARTS))])
    return pages.select(*dict.fromkeys([*keep, "html"])).mapInPandas(run, schema)


def padded(text: str | None) -> bytes:
    """UTF-8 bytes with spaces up to a positive multiple of a row."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The payload of a PNG that to_png wrote; its checksums are verified."""
    if data[:8] != PNG:
        raise ValueError("not a PNG")
    at, body, head = 8, [], b""
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged PNG")
        head, at = part if kind == b"IHDR" else head, at + 12 + n
        body += [part] if kind == b"IDAT" else []
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(struct.unpack_from(">I", head, 4)[0], ROW + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, the channels' sums, and a 64-bit average hash of an 8 by 8 grid of grey sums; whole numbers only."""
    px = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    sums = px.sum(axis=(0, 1), dtype=np.int64)
    cut = np.arange(8) * len(px) // 8
    grey = px.sum(axis=2, dtype=np.int64).reshape(len(px), 8, 8).sum(axis=2)
    total = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(grey, axis=0)])
    upper = np.maximum(np.append(cut[1:], len(px)), cut + 1)
    cells = (total[upper] - total[cut]) // (upper - cut)[:, None]
    bits = (cells * 64 > cells.sum()).ravel()
    return f"rows={len(px)};sum={sums[0]},{sums[1]},{sums[2]};ahash={int(''.join('01'[int(b)] for b in bits), 2):016x}"


def stored(texts: DataFrame) -> DataFrame:
    """A description of each distinct payload's stored form, keyed by the payload's digest, and how many copies there are, from text(text)."""

    def run(frames):
        for pdf in batches(frames, 1 << 22):
            rows = []
            for text in pdf["text"]:
                payload = padded(text)
                media = to_png(payload)
                back = from_png(media)
                digest = hashlib.sha256(back).hexdigest()
                rows.append((hashlib.sha256(payload).hexdigest(), len(back), digest, zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STORED.split(", ")])

    each = texts.select("text").mapInPandas(run, STORED)
    return each.groupBy("digest").agg(F.min(F.struct(*each.columns[1:])).alias("media"), F.count("*").alias("copies")).select("digest", "media.*", "copies")


def references(sequenced: DataFrame) -> DataFrame:
    """One row for each part of each sequence, beside the kept columns."""
    rest = [c for c in sequenced.columns if c != "parts"]
    return sequenced.select(*rest, F.explode("parts").alias("part")).select(*rest, "part.*")


def resolve(parts: DataFrame, store: DataFrame) -> DataFrame:
    """Parts with the media that their digests name; parts without a medium keep their place.

    Where the store says in ``copies`` how many parts name each medium, the most named are sent to all tasks.
    """
    return matched(parts, store, ["digest"], "copies", "left", HOT) if "copies" in store.columns else parts.join(store, "digest", "left")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored medium of every document, through its page's reference."""
    parts = references(sequences(carriers(docs), ["doc_id", "n_bytes"])).where("kind = 'media'").select("doc_id", "n_bytes", "digest", "position", "caption")
    parts, store = materialise(parts, "media-parts"), materialise(stored(docs), "media-store")
    return resolve(parts, store).select("doc_id", "n_bytes", *(c.split()[0] for c in STORED.split(", ")[1:]), "position", "caption")


def carriers(docs: DataFrame) -> DataFrame:
    """For each document a page of one text run and one reference to the document's payload: doc_id, n_bytes, html."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    fill = F.when(n == 0, ROW).otherwise(F.pmod(-n, F.lit(ROW))).cast("int")
    digest = F.sha2(F.concat(raw, F.encode(F.repeat(F.lit(" "), fill), "UTF-8")), 256)
    page = F.concat(F.lit("<article><p>bytes "), n.cast("string"), F.lit('</p><figure><img src="sha256:'), digest, F.lit('"><figcaption>document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure></article>"))
    return docs.select(F.col("doc_id"), n.cast("long").alias("n_bytes"), page.alias("html"))
