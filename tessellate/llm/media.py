"""Media columns: interleaved document sequences and losslessly stored payloads.

A page's HTML becomes an ordered array of structs, text blocks and media references in
page order, each reference with its digest and the caption that belongs to it.  Payloads
live apart, once for each digest (and writing task), as 8-bit grey PNG images; a join on
the digest resolves references.  What is joined is what a reader of the stored bytes
computed, so large payloads never travel with the sequences, however many copies refer to
one digest; a digest that many sequences share is one row on the payload side, so Spark
can split the other side.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, written

WIDTH = 64
#: Bytes that start every PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:"
ITEM = "struct<position: int, kind: string, text: string, source: string, digest: string, caption: string>"
ITEM_TYPE = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("source", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
FACTS = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
FACTS_DDL = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
#: Elements that stay inside a text block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext nobr picture q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset(("script", "style", "template", "noscript"))


# -- stored form -----------------------------------------------------------------------


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``unit``."""
    return data + b"\0" * (max(1, -(-len(data) // unit)) * unit - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey image of 64 samples a row; the payload's length is a multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row starts with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an 8-bit grey image with unfiltered rows; anything else is a ValueError."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at, data, width = len(SIGNATURE), b"", 0
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, _, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise ValueError("not an 8-bit grey image")
        elif kind == b"IDAT":
            data += body
        at += n + 12
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows aren't supported")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """A difference hash of the image shrunk to 8 x 9, and a 16-bin histogram in log2 steps, in hex."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    rows = np.linspace(0, len(image), 9).astype(int)[:-1]
    sums = np.add.reduceat(image.astype(np.int64), np.minimum(rows, len(image) - 1), axis=0)
    grid = np.add.reduceat(sums, np.arange(0, 63, 7), axis=1)[:, :9]
    bits = np.packbits(grid[:, 1:9] > grid[:, :8]).tobytes().hex()
    counts = np.bincount(np.frombuffer(samples, np.uint8) >> 4, minlength=16)
    steps = np.minimum(15, np.ceil(np.log2(counts + 1) * 15 / np.log2(len(samples) + 1))).astype(int)
    return bits + "-" + "".join(f"{s:x}" for s in steps)


# -- sequences -------------------------------------------------------------------------


class _Sequence(HTMLParser):
    """Collects text blocks and media references; a figure's caption joins its references.

    Every ``src`` is a reference; only those of stored payloads have a digest.  A caption goes
    to all media of its figure that have none of their own figure, whichever comes first; one
    without media stays as text in its place.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.hidden = [], [], 0
        self.figures: list[tuple[int, list]] = []  # where each open figure's items begin, and its captions (place, text)
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            if self.caption is not None:
                self.caption.append(text)
            else:
                self.items.append({"kind": "text", "text": text, "source": None, "digest": None, "caption": None})
        self.text = []

    def end_caption(self) -> None:
        if self.caption is not None and self.figures:
            self.figures[-1][1].append((len(self.items), " ".join(self.caption)))
        self.caption = None

    def end_figure(self) -> None:
        self.end_caption()
        start, captions = self.figures.pop()
        media = [x for x in self.items[start:] if x["kind"] == "media"]
        if media and captions:
            for item in media:
                item["caption"] = " ".join(c for _, c in captions)
        else:
            for at, caption in reversed(captions):
                self.items.insert(at, {"kind": "text", "text": caption, "source": None, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in INLINE:
            self.text.append(" " if tag == "br" else "")
        else:
            self.flush()
            given = dict(attrs)
            if tag == "figure":
                self.figures.append((len(self.items), []))
            elif tag == "figcaption" and self.figures:
                self.caption = []
            elif (source := given.get("src")) and not self.hidden:
                self.items.append({"kind": "media", "text": None, "source": source, "digest": source[len(SCHEME) :] if source.startswith(SCHEME) else None, "caption": given.get("alt")})

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag not in INLINE:
            self.flush()
            if tag == "figcaption":
                self.end_caption()
            elif tag == "figure" and self.figures:
                self.end_figure()

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    def finish(self) -> list[dict]:
        self.close()
        self.flush()
        while self.figures:
            self.end_figure()
        return [{"position": i, **x} for i, x in enumerate(self.items)]


def parse_sequence(html: str | None) -> list[dict]:
    """Items of a page in order, with positions from 0; an empty or null page has none."""
    parser = _Sequence()
    parser.feed(html or "")
    return parser.finish()


def sequences(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns and ``items``: the ordered text and media-reference structs of each page."""
    fields = ", ".join(f"{c} {pages.schema.fields[pages.columns.index(c)].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([parse_sequence(h) for h in batch.column("h").to_pylist()], pa.list_(ITEM_TYPE))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), items], [*keep, "items"])

    return pick(pages, h=html_col, **{c: c for c in keep}).mapInArrow(run, f"{fields}, items array<{ITEM}>")


def references(sequence: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per media reference: ``keep``, ``position``, ``source``, ``digest``, ``caption``."""
    item = F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item")
    return sequence.select(*keep, item).select(*keep, "item.position", "item.source", "item.digest", "item.caption")


def read_back(media: DataFrame) -> DataFrame:
    """Facts and features of stored media (``digest, media``), from the samples read back; one row per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column("media"):
                stored = stored.as_py()
                samples = from_png(stored)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(FACTS), FACTS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *columns], ["digest", *FACTS])

    found = media.select("digest", "media").mapInArrow(run, f"digest string, {FACTS_DDL}")
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in FACTS])


def resolve(refs: DataFrame, facts: DataFrame) -> DataFrame:
    """References with the facts of their payloads; a digest that isn't stored resolves to nulls."""
    return refs.join(facts, "digest", "left")


# -- documents as media ----------------------------------------------------------------


def illustrated_html(text: str, digest: str, n_bytes: int) -> str:
    """A page of the text's lines as paragraphs, with the payload as a figure in their middle."""
    lines = [f"<p>{escape(x)}</p>" for x in text.split("\n")]
    figure = f'<figure><img src="{SCHEME}{digest}"><figcaption>{n_bytes} bytes of text</figcaption></figure>'
    half = len(lines) // 2
    return "<article>" + "".join([*lines[:half], figure, *lines[half:]]) + "</article>"


def document_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, items``: every whole text as an interleaved sequence of its lines and its payload's reference."""
    kind = docs.schema.fields[docs.columns.index(id_col)].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, sizes, items = batch.slice(at, 512), [], []
                for text in part.column("t"):
                    text = text.as_py() or ""
                    data = text.encode()
                    sizes.append(len(data))
                    items.append(parse_sequence(illustrated_html(text, hashlib.sha256(padded(data)).hexdigest(), len(data))))
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(sizes, pa.int64()), pa.array(items, pa.list_(ITEM_TYPE))], ["doc_id", "n_bytes", "items"])

    return pick(docs, k=id_col, t=text_col).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, items array<{ITEM}>")


def payloads(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``digest, media``: the stored form of every whole text, once for each digest and task.

    A null text counts as empty; an empty text is stored as 64 zero bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: set[bytes] = set()
        for batch in batches:
            rows, size = [], 0
            for text in batch.column("t"):
                payload = padded((text.as_py() or "").encode())
                key = hashlib.sha256(payload).digest()
                if key not in stored:
                    stored.add(key)
                    rows.append((key.hex(), to_png(payload)))
                    size += len(payload)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["digest", "media"])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["digest", "media"])

    return pick(docs, t=text_col).mapInArrow(run, "digest string, media binary")


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as media, read the stored bytes back, and resolve each document's reference.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature``; equal texts have equal values.  Repeated or null ids stay as
    they are; an empty table gives an empty table.  Facts are on disk before the join, so a
    digest that very many documents share can be split over tasks.
    """
    facts = written(read_back(written(payloads(docs, text_col), "media")), "media-facts")
    refs = references(document_sequences(docs, id_col, text_col), keep=("doc_id", "n_bytes"))
    return resolve(refs, facts).select("doc_id", "n_bytes", *FACTS)
