"""Media columns: documents as ordered sequences of text and media references.

HTML parsing yields a document's parts in order: text, or a reference to a
payload by digest, with its caption. A media store keeps each payload once, as a
lossless 8-bit grey PNG of 192 samples a row. References meet the store by
digest; the stored bytes are read back once per payload, never per reference, so
a payload that a third of all documents show costs no more than another.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_text import Node, _lines, _visible, parse

ROW = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:sha256/"


def pad(payload: bytes) -> bytes:
    """The payload with blanks up to a positive multiple of 192 bytes."""
    return payload + b" " * (-len(payload) % ROW if payload else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grey PNG whose samples are the payload's bytes; its length must be a positive multiple of 192."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Samples (rows, 192) of a stored image; raises ValueError where it is damaged."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a stored image")
    at, size, body = 8, None, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of image")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Height, mean, deviation and a 64-bit gradient hash of the image's 8 x 9 block means."""
    tall = len(samples)
    row_sums = np.add.reduceat(samples.astype(np.float64).reshape(tall, -1), np.arange(0, ROW - ROW % 9, ROW // 9)[:9], axis=1)
    edges = np.minimum(np.arange(8) * tall // 8, tall - 1)
    blocks = np.stack([row_sums[a : max(b, a + 1)].mean(0) for a, b in zip(edges, [*edges[1:], tall], strict=True)])
    bits = (blocks[:, 1:] > blocks[:, :-1]).reshape(-1)
    return f"{tall}x{ROW}:{samples.mean():.4f}:{samples.std():.4f}:{int(''.join('1' if b else '0' for b in bits), 2):016x}"


# ---------------------------------------------------------------- documents


def sequence(source: str | None) -> list[dict]:
    """Ordered parts of an HTML document: position, kind (text or media), text, digest and caption.

    A figure's caption belongs to every reference in it, else the alt text does.
    """
    out: list[dict] = []
    inline: list = []

    def flush() -> None:
        holder = Node("div", {})
        holder.parts = list(inline)
        inline.clear()
        lines = "\n".join(_lines(holder))
        if lines:
            out.append({"position": len(out), "kind": "text", "text": lines, "digest": None, "caption": None})

    def holds_media(node: Node) -> bool:
        return any(isinstance(p, Node) and (p.attrs.get("src", "").startswith(SCHEME) or holds_media(p)) for p in node.parts)

    def walk(node: Node, caption: str | None) -> None:
        for part in node.parts:
            if isinstance(part, str):
                inline.append(part)
            elif part.attrs.get("src", "").startswith(SCHEME):
                flush()
                out.append({"position": len(out), "kind": "media", "text": None, "digest": part.attrs["src"][len(SCHEME) :].lower(), "caption": caption if caption is not None else part.attrs.get("alt")})
            elif not _visible(part) and part.tag not in ("audio", "video"):
                continue
            elif holds_media(part):
                own = caption
                if part.tag == "figure":
                    caps = [p for p in part.parts if isinstance(p, Node) and p.tag == "figcaption"]
                    own = "\n".join(_lines(caps[0])) if caps else caption
                    part.parts = [p for p in part.parts if p not in caps]
                flush()
                walk(part, own)
                flush()
            else:
                inline.append(part)

    walk(parse(source or ""), None)
    flush()
    return out


PARTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_PARTS_ARROW = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def interleave(pages: DataFrame, id_column: str, html_column: str = "html") -> DataFrame:
    """(id, parts): the ordered parts of each page. A null page has none."""
    slim = pages.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{html_column}`").alias("html"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sequence(x) for x in batch.column(1).to_pylist()], _PARTS_ARROW)], names=["id", "parts"])

    return slim.mapInArrow(run, f"id long, parts {PARTS}")


def _read_back(batches):
    for batch in batches:
        out = []
        for media in batch.column(1).to_pylist():
            samples = from_png(media)
            payload = samples.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(payloads: DataFrame) -> DataFrame:
    """The media store of ``payloads(digest, media)``: one row per digest. Copies meet in the map-side aggregate first."""
    return payloads.groupBy("digest").agg(F.min("media").alias("media"))


def read_back(stored: DataFrame) -> DataFrame:
    """Per stored payload: digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return stored.select("digest", "media").mapInArrow(_read_back, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(sequences: DataFrame, resolved: DataFrame) -> DataFrame:
    """``sequences(id, parts)`` with one row per media reference: id, position, digest, caption and what ``resolved`` has of the digest, nulls where it's missing."""
    refs = sequences.select("id", F.explode(F.filter("parts", lambda p: p["kind"] == "media")).alias("p")).select("id", "p.position", "p.digest", "p.caption")
    return refs.join(resolved, "digest", "left")


def text_payloads(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents as media: (pages(doc_id, n_bytes, html), payloads(digest, media)).

    The UTF-8 of a text (null: empty), padded, is the payload; the page shows it
    in a figure whose caption is the document's id.
    """
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(raw).cast("long")
    short = F.pmod(-n, F.lit(ROW)) + F.when(n == 0, ROW).otherwise(0)
    padded = F.concat(raw, F.repeat(F.lit(" "), short.cast("int")).cast("binary"))
    digest = F.sha2(padded, 256)
    page = F.concat(F.lit("<article><h1>document</h1><figure><img src='" + SCHEME), digest, F.lit("' alt='text'><figcaption>document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.lit("</figcaption></figure></article>"))

    def encode(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 512):
                payloads = [pad((t or "").encode()) for t in texts[i : i + 512]]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([to_png(p) for p in payloads], pa.binary())], names=["digest", "media"])

    return slim.select("doc_id", n.alias("n_bytes"), page.alias("html")), slim.select("text").mapInArrow(encode, "digest string, media binary")


def text_media(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes and the columns of :func:`read_back`, through page, reference and digest join.

    Equal texts share one stored payload. Repeated rows stay; an empty table
    gives an empty result.
    """
    pages, payloads = text_payloads(docs)
    found = resolve(interleave_with(pages), read_back(store(payloads)))
    return found.select("id.doc_id", "id.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def interleave_with(pages: DataFrame) -> DataFrame:
    """Like :func:`interleave`, with every other column of the pages as ``id``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = [c for c in pages.columns if c != "html"]
    slim = pages.select(F.struct(*kept).alias("id"), "html")
    schema = StructType.fromDDL(f"parts {PARTS}")
    schema = StructType([slim.schema["id"], schema["parts"]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            parts = pa.array([sequence(x) for x in batch.column(1).to_pylist()], _PARTS_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), parts.cast(arrow.field(1).type)], schema=arrow)

    return slim.mapInArrow(run, schema)


