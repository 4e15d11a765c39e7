"""Media columns as interleaved document sequences.

An HTML document becomes an ordered list of text and media-reference structs; a reference names its payload by digest. A
media store keeps each payload losslessly as an 8-bit gray image (PNG). References are exploded with their positions,
joined with what the store's images hold by digest, and stand at the same positions, with the same captions, as before.

Scale: payload bytes are encoded and decoded where they are read and never shuffled; the digest join moves digests,
positions and features only. Equal payloads have equal digests, so their features are one row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.session import materialize

WIDTH = 192
_HEAD = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes) -> bytes:
    """A gray 8-bit PNG, ``WIDTH`` samples a line; the payload is a positive multiple of it."""
    lines = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(lines), 1), dtype=np.uint8), lines], axis=1).tobytes()
    return _HEAD + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 1)) + _chunk(b"IEND", b"")


def from_image(stored: bytes) -> bytes:
    """The samples of such an image; checksums are verified."""
    if not stored.startswith(_HEAD):
        raise ValueError("not a stored image")
    at, data = len(_HEAD), b""
    while at < len(stored):
        (n,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        if kind == b"IHDR":
            width, _ = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and 64 cells brighter than the mean, of an image's samples."""
    x = np.frombuffer(samples, dtype=np.uint8)
    edge = np.arange(64) * len(x) // 64
    cells = np.add.reduceat(x, edge, dtype=np.int64) / np.diff(np.append(edge, len(x)))
    bits = int(np.packbits(cells > x.mean()).view(">u8")[0])
    return f"{x.mean():.4f}:{x.std():.4f}:{bits:016x}"


def padded(text: Column) -> Column:
    """A text's bytes (null: none) with blanks up to a positive multiple of ``WIDTH``."""
    t = F.coalesce(text, F.lit(""))
    n = F.octet_length(t)
    return F.concat(t, F.repeat(F.lit(" "), F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH))).cast("int"))).cast("binary")


def store(payloads: DataFrame) -> DataFrame:
    """A media table ``(digest, stored)`` of a column ``payload``, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b["payload"].slice(at, 500).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in part], pa.string()), pa.array(map(to_image, part), pa.binary())], names=["digest", "stored"])

    return materialize(payloads.where("payload is not null").select("payload").mapInArrow(run, "digest string, stored binary"))


def read_back(media: DataFrame) -> DataFrame:
    """What each stored image holds: ``digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``, a row per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, stored in zip(b["digest"].to_pylist(), b["stored"]):
                stored = stored.as_py()
                p = from_image(stored)
                rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(p)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = media.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.groupBy("digest").agg(*[F.min(c).alias(c) for c in found.columns[1:]])


class _Items(HTMLParser):
    """Ordered items of a document: text blocks, and references with their captions."""

    BLOCK = frozenset("p div section article figure figcaption h1 h2 h3 h4 h5 h6 li ul ol table tr td blockquote pre br hr body".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.figure: int | None = None
        self.caption = False
        self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if not text:
            return
        if self.caption and self.figure is not None and self.figure < len(self.items):
            for item in self.items[self.figure :]:
                item["caption"] = text
        else:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.flush()
        a = dict(attrs)
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = True
        elif tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("img", "audio", "video", "source") and (a.get("src") or "").startswith("sha256:"):
            self.flush()
            self.items.append({"position": len(self.items), "kind": "media", "text": None, "digest": a["src"][7:], "caption": a.get("alt")})

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.flush()
        if tag == "figure":
            self.figure = None
        elif tag == "figcaption":
            self.caption = False
        elif tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def parse(html: str | None) -> list[dict]:
    p = _Items()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.items


ITEM = "struct<position: int, kind: string, text: string, digest: string, caption: string>"


def sequences(pages: DataFrame, carry: list[str]) -> DataFrame:
    """``row, items``: the ordered text and media structs of a column ``html``; null or empty HTML has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                yield pa.RecordBatch.from_arrays([b["row"].slice(at, 500), pa.array([parse(h) for h in b["html"].slice(at, 500).to_pylist()], kind)], names=["row", "items"])

    d = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), "html")
    return d.mapInArrow(run, f"row {d.schema['row'].dataType.simpleString()}, items array<{ITEM}>")


def resolve(seqs: DataFrame, found: DataFrame) -> DataFrame:
    """Media references with what their payload holds, a row each: ``row, position, digest, caption`` and the columns of
    ``read_back`` (null where the store has no such digest). Text before and after keeps its positions in ``items``."""
    refs = seqs.select("row", F.explode(F.expr("filter(items, x -> x.kind = 'media')")).alias("x")).select("row", "x.position", "x.digest", "x.caption")
    return refs.join(found, "digest", "left")


def as_page(text: Column, digest: Column, caption: Column) -> Column:
    """A text as an HTML document: a paragraph for each line, then a figure that refers to the text's payload."""
    t = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "</p><p>")):
        t = F.replace(t, F.lit(a), F.lit(b))
    c = F.coalesce(caption, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit("<article><p>"), t, F.lit('</p><figure><img src="sha256:'), digest, F.lit('"><figcaption>'), c, F.lit("</figcaption></figure></article>"))


def document_media(docs: DataFrame) -> DataFrame:
    """Every text as a stored image, found again through the sequence of its page: a row per document.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption``.

    Defined cases: a null or empty text is one line of blanks; equal texts have equal values; repeated rows and null
    ids each have their row; an empty table gives no rows.
    """
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("caption"), padded(F.col("text")).alias("payload"))
    found = read_back(store(d))
    pages = d.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), as_page(F.col("text"), F.sha2("payload", 256), F.col("caption")).alias("html"))
    refs = resolve(sequences(pages, ["doc_id", "n_bytes"]), found)
    return refs.select("row.doc_id", "row.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
