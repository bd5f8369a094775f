"""Interleaved document sequences: ordered text and media references, with payloads resolved by digest.

HTML is parsed into one ordered sequence of structs: text blocks and media references, each with its position; a reference carries the
digest it names and its caption. Payloads live in a media table as PNG images of 8-bit grey samples, keyed by
the SHA-256 of the payload. Features of a payload are computed where its stored bytes are read, so that the digest
join moves a short row for each reference and each distinct payload, never the payloads themselves.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.html import end_tags
from tidemark.llm.shared import map_rows, small_batches, types_of
from tidemark.plans.scratch import scratch_path

WIDTH, FILL, LEVEL, MAX_SEEN = 576, 255, 1, 200_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: But for the first two, skipped only where they are closed: a page that forgets to close one is read on.
_SKIPPED = {"script", "style", "noscript", "template", "title"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
_BLOCKS = {"p", "div", "article", "section", "figure", "figcaption", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "nav", "body", "blockquote", "pre"}


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(length of the UTF-8 bytes, these filled up with 255 to a positive multiple of the image's width)."""
    raw = (text or "").encode("utf-8")
    rows = max(1, -(-len(raw) // WIDTH))
    return len(raw), raw + bytes([FILL]) * (rows * WIDTH - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """The payload as 8-bit grey samples, WIDTH to a row, losslessly; no row is filtered."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    rows = np.concatenate([np.zeros((len(samples), 1), np.uint8), samples], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(stored: bytes) -> bytes:
    """The samples of an image that encode_png() wrote; raises ValueError if a checksum or the form is wrong."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, data, width, height = 8, b"", 0, 0
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + n]
        if struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and 64 bits: is each of 64 equal parts brighter than the mean?"""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256).astype(float)
    mean = float(counts @ np.arange(256)) / len(samples)
    spread = float(np.sqrt(counts @ (np.arange(256) - mean) ** 2 / len(samples)))
    share = counts[counts > 0] / len(samples)
    parts = np.add.reduceat(samples, np.arange(64) * len(samples) // 64, dtype=np.int64) / (len(samples) / 64)
    return f"{mean:.6f};{spread:.6f};{-float(share @ np.log2(share)) + 0.0:.6f};{int(np.packbits(parts > mean).view('>u8')[0]):016x}"


class _Sequence(HTMLParser):
    def __init__(self, closed: Counter):
        super().__init__(convert_charrefs=True)
        self.items: list[list[str | None]] = []
        self.text, self.figures, self.caption = [], [], None
        self.closed, self.skip = closed, Counter()  # closing tags to come; open tags whose content is skipped

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.items.append(["text", text, None, None])

    def close_figure(self) -> None:
        items, said = self.figures.pop()
        for item in items if said else []:
            item[3] = " ".join(said)

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED and (tag in ("script", "style") or self.closed[tag] > self.skip[tag]):
            self.skip[tag] += 1
        if self.skip.total():
            return
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append(([], []))
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA:
            self.flush()
            own = dict(attrs)
            if own.get("src"):
                item = ["media", None, own["src"], own.get("alt") or own.get("title")]
                self.items.append(item)
                if self.figures:
                    self.figures[-1][0].append(item)

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.closed[tag] -= 1
            self.skip[tag] = max(0, self.skip[tag] - 1)
            return
        if self.skip.total():
            return
        if tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            self.caption = None
            if self.figures and said:
                self.figures[-1][1].append(said)
        elif tag == "figure" and self.figures:
            self.close_figure()
        if tag in _BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.skip.total():
            return
        (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[list[str | None]]:
    """[kind, text, source, caption] in document order; a figure's caption goes to its media, wherever it stands."""
    parser = _Sequence(end_tags(html or ""))
    parser.feed(html or "")
    parser.close()
    parser.flush()
    while parser.figures:
        parser.close_figure()
    return parser.items


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, sequence array<struct<position, kind, text, source, digest, caption>>.

    digest: what follows `sha256:` in the source, else null. Null or empty HTML gives an empty sequence; malformed
    HTML is read as the parser recovers it (a head, template or title that is never closed hides nothing); very long pages are
    read whole; repeated rows and null ids give rows like any other. Only the two named columns are read; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    names = ("kind", "body", "source", "caption")

    def batch(b: pa.RecordBatch):
        found = [parse_sequence(h) for h in b.column(1).to_pylist()]
        return {id_col: b.column(0)} | {c: [[x[i] for x in f] for f in found] for i, c in enumerate(names)}

    rows = map_rows(pages.select(id_col, html_col), {id_col: types_of(pages)[id_col]} | dict.fromkeys(names, "array<string>"), lambda: batch)
    zipped = F.arrays_zip(F.transform("kind", lambda x, i: i), *names)
    made = F.transform(zipped, lambda s: F.struct(s["0"].alias("position"), s["kind"].alias("kind"), s["body"].alias("text"), s["source"].alias("source"), F.nullif(F.regexp_extract(s["source"], "^sha256:([0-9a-f]{64})$", 1), F.lit("")).alias("digest"), s["caption"].alias("caption")))
    return rows.select(id_col, made.alias("sequence"))


def store_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes a row for each document: id, n_bytes, digest, media (PNG; null where this task has stored the digest before).

    A null text is an empty one; repeated rows and null ids are rows like any other; an empty table writes none.
    """
    small_batches(docs.sparkSession)

    def build():
        seen: set[bytes] = set()

        def batch(b: pa.RecordBatch):
            sizes, digests, media = [], [], []
            for text in b.column(1).to_pylist():
                n, payload = payload_of(text)
                digest = hashlib.sha256(payload)
                fresh = digest.digest() not in seen
                if len(seen) >= MAX_SEEN:
                    seen.clear()
                seen.add(digest.digest())
                sizes.append(n)
                digests.append(digest.hexdigest())
                media.append(encode_png(payload) if fresh else None)
            return {id_col: b.column(0), "n_bytes": sizes, "digest": digests, "media": media}

        return batch

    kind = types_of(docs)[id_col]
    map_rows(docs.select(id_col, text_col), {id_col: kind, "n_bytes": "long", "digest": "string", "media": "binary"}, build).write.option("compression", "none").parquet(path)


def stored_features(media: DataFrame) -> DataFrame:
    """From stored bytes, a row for each distinct digest: digest and what the payload and its stored form are like.

    Rows without media are passed over; broken bytes raise ValueError; equal digests, of any number of rows, give one row.
    """
    columns = {"digest": "string", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}

    def batch(b: pa.RecordBatch):
        out = {c: [] for c in columns}
        for digest, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            payload = decode_png(stored)
            for c, v in zip(out, (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)), strict=True):
                out[c].append(v)
        return out

    return map_rows(media.where("media is not null").select("digest", "media"), columns, lambda: batch).dropDuplicates(["digest"])


def resolve(found: DataFrame, media: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, position, caption and the features for each media reference of `sequences()`, aligned with its place in the text.

    Digests that are null or unknown give null features; a sequence without references gives no rows; repeated rows and
    null ids give rows like any other.
    """
    refs = found.select(id_col, F.explode("sequence").alias("s")).where("s.kind = 'media'")
    refs = refs.select(id_col, F.col("s.position").alias("position"), F.col("s.caption").alias("caption"), F.col("s.digest").alias("digest"))
    return refs.join(stored_features(media), "digest", "left")


def payload_digest(text: Column) -> Column:
    """The digest of payload_of(text)."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    fill = F.greatest(F.lit(WIDTH), F.ceil(n / WIDTH).cast("int") * WIDTH) - n
    return F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit(f"{FILL:02X}"), fill))), 256)


def illustrated(text: Column) -> Column:
    """HTML of a text's lines as paragraphs, with a figure that refers to the text's payload after the first."""
    said = F.coalesce(text, F.lit(""))
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    first = F.substring_index(said, "\n", 1)
    rest = F.substring(said, F.length(first) + 2, F.length(said))
    figure = F.concat(F.lit("<figure><img src='sha256:"), payload_digest(text), F.lit("' alt=''><figcaption>"), F.octet_length(said).cast("string"), F.lit(" bytes</figcaption></figure>"))
    return F.concat(F.lit("<p>"), safe(first), F.lit("</p>"), figure, F.lit("<p>"), F.replace(safe(rest), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Stores every text as an image; reads a page of the text's own paragraphs with a figure among them, and resolves the figure.

    Returns id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position (of the
    figure in its page's sequence: 1 after a first line of text, 0 where that line is blank), caption. A null text is an
    empty one (one row of fill); equal texts share one digest; null ids and repeated rows give rows like any other; an
    empty table gives none. Only the two named columns are read.
    """
    path = path or scratch_path(docs.sparkSession, "media")
    store_texts(docs, path, id_col, text_col)
    text = F.col(text_col)
    page = F.struct(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    pages = docs.select(page.alias("page"), illustrated(text).alias("html"))
    done = resolve(sequences(pages, "page", "html"), docs.sparkSession.read.parquet(path), "page")
    return done.select(F.col("page.id").alias(id_col), "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
