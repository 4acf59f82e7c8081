"""Interleaved sequences of text and media: parsing, lossless payload storage, digest joins."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size

ITEM = "struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>"
WIDTH = 64
_DIGEST = re.compile(r"sha256[:/-]([0-9a-f]{64})")
_QUIET = {"script", "style", "template", "noscript", "title"}
_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "article", "section", "blockquote", "pre", "br", "td", "th", "ul", "ol", "table", "nav", "header", "footer", "figure"}
_MEDIA = {"img", "video", "audio", "source", "embed"}


class _Sequence(HTMLParser):
    """Items in document order. A figure's caption goes to every media item of the figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.quiet = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = "".join(self.words)
        self.words = []
        if text.strip():
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag, attrs):
        if tag in _QUIET:
            self.quiet += 1
        elif tag in _MEDIA:
            a = dict(attrs)
            if src := a.get("src"):
                self.flush()
                digest = _DIGEST.search(a.get("integrity") or "") or _DIGEST.search(src)
                self.items.append({"kind": "media", "src": src, "digest": digest and digest[1], "caption": a.get("alt") or None})
                if self.figure is not None:
                    self.figure.append(self.items[-1])
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []

    def handle_endtag(self, tag):
        if tag in _QUIET:
            self.quiet = max(0, self.quiet - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = "".join(self.caption).strip()
            for item in self.figure or []:
                item["caption"] = text or item["caption"]
            self.caption = None
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.quiet:
            (self.words if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """Ordered items of a page; position counts text and media together."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"position": k, "text": None, "src": None, "digest": None, "caption": None} | item for k, item in enumerate(p.items)]


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, items and the columns of keep: the page's text runs and media references in document order.

    Null or empty pages have no items; broken markup is read as far as it makes sense. Repeated rows repeat.
    """
    names = [f.split(":")[0] for f in ITEM[7:-1].split(",")]
    kind = pa.list_(pa.struct([(n, pa.int32() if n == "position" else pa.string()) for n in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1):
                items = [[{n: x[n] for n in names} for x in parse(cell.as_py())] for cell in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(items, kind)], names=["key", *keep, "items"])

    rows = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"), *keep)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in [rows.schema[0], *rows.schema[2:]])
    return rows.mapInArrow(run, f"{kinds}items array<{ITEM}>")


def references(sequences: DataFrame) -> DataFrame:
    """One row per media item: position, caption, src, digest, and the other columns of sequences."""
    rest = [c for c in sequences.columns if c != "items"]
    return sequences.select(*rest, F.explode("items").alias("i")).where("i.kind = 'media'").select(*rest, "i.position", "i.caption", "i.src", "i.digest")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """refs with the columns of media (one row per digest) that their digests name; unresolved references get nulls.

    A digest that a third of all references share is a skewed join key on the refs side only: adaptive execution
    splits it, as the media side has one row for it.
    """
    return refs.join(media, "digest", "left")


# ---- payloads ------------------------------------------------------------------------------------------------------


def payload(raw: bytes) -> bytes:
    """raw and zero bytes up to a positive multiple of the image's width."""
    return raw + bytes(-len(raw) % WIDTH) if raw else bytes(WIDTH)


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def store(data: bytes) -> bytes:
    """An 8-bit grey PNG, 64 samples wide, whose samples are the payload."""
    rows = np.zeros((len(data) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with filter 0
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, 1)) + _chunk(b"IEND", b"")


def load(stored: bytes) -> np.ndarray:
    """The samples of an image that store() made."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(stored):
        n, name = struct.unpack(">I4s", stored[at : at + 8])
        body = memoryview(stored)[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(name)) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if name == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif name == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("only filter 0 is written here")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Rows, the mean in thousandths and a 64-bit average hash of an 8 x 8 thumbnail."""
    bands = np.linspace(0, len(samples), 9).astype(np.int64)
    sums = samples.reshape(len(samples), 8, 8).sum(2, dtype=np.int64)
    total = np.vstack([np.zeros((1, 8), np.int64), sums.cumsum(0)])
    thumb = (total[bands[1:]] - total[bands[:-1]]) / np.maximum(1, (bands[1:] - bands[:-1]) * 8)[:, None]
    bits = np.packbits(thumb > samples.mean()).tobytes().hex()
    return f"{len(samples)}:{int(total[-1].sum()) * 1000 // samples.size}:{bits}"


def _padded(text: Column) -> Column:
    """payload() of a text as a column."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    zeros = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.concat(raw, F.substring(F.lit(bytes(WIDTH)), F.lit(1), zeros))


def digest(text: Column) -> Column:
    return F.sha2(_padded(text), 256)


def render(key: Column, text: Column) -> Column:
    """A page as it is published: the text in paragraphs, its payload's figure after the first, captioned by the key."""
    safe = F.coalesce(text.cast("string"), F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(mark), F.lit(entity))
    caption = F.coalesce(key.cast("string"), F.lit(""))
    figure = F.concat(F.lit('<figure><img src="media/sha256-'), digest(text), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    first = F.substring_index(safe, "\n", 1)
    rest = F.substr(safe, F.length(first) + 1)
    return F.concat(F.lit("<article><p>"), first, F.lit("</p>"), figure, F.lit("<p>"), F.replace(rest, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article>"))


def pages_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html: a rendered page for each document."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size, render(F.col("doc_id"), F.col("text")).alias("html"))


def store_texts(docs: DataFrame) -> DataFrame:
    """digest (of the payload) and stored: one row per different payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 0):
                digests, kept = [], []
                for cell in part.column(0):
                    data = payload((cell.as_py() or "").encode())
                    digests.append(hashlib.sha256(data).hexdigest()), kept.append(store(data))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["digest", "stored"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "digest string, stored binary").dropDuplicates(["digest"])


def describe(media: DataFrame) -> DataFrame:
    """What reading the stored bytes back gives, for each digest."""
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for digest, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stored = cell.as_py()
                samples = load(stored)
                data = samples.tobytes()
                sha = hashlib.sha256(data).hexdigest()
                if sha != digest:
                    raise ValueError(f"payload {digest} reads back as {sha}")
                out.append((digest, len(data), sha, zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            if out:
                names = [x.split()[0] for x in schema.split(", ")]
                kinds = [pa.int64() if "long" in x else pa.string() for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return media.select("digest", "stored").mapInArrow(run, schema)


def document_media(docs: DataFrame) -> DataFrame:
    """Each document's payload, found through the media reference of its page and read back from the stored form, with the
    position and caption that the reference has on the page.

    Null text is empty: its payload is 64 zero bytes. Texts that differ only in zero bytes at their ends share a payload
    but not n_bytes. A null doc_id stays null; repeated rows repeat; equal texts get equal values. Texts of any length
    are stored whole. An empty table gives no row. Other columns are ignored.
    """
    refs = references(interleave(pages_of(docs), "doc_id", keep=("n_bytes",)))
    return resolve(refs, describe(store_texts(docs))).select(F.col("key").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
