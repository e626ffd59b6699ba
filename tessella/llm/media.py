"""Interleaved documents of text and media, with payloads in a content-addressed table.

``parse_interleaved`` turns HTML into an ordered sequence of structs, each a text
block or a reference to a medium by its digest, with position and caption.
``store_media`` writes payloads as media (losslessly, as the 8-bit samples of a
greyscale PNG) under the digest of the payload; ``resolve`` joins references to the
store by digest, so positions and captions stay aligned with what they belong to.
Equal payloads have one digest and one resolved row.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, fresh, map_rows, new_path, ship, str_texts
from .htmltext import BLOCK, Node, attributes, parse

#: Samples in a row of the picture; payloads are padded to whole rows.
WIDTH = 64
_PNG = b"\x89PNG\r\n\x1a\n"
REFERENCE = "media:sha256:"
ITEM = "struct<pos:int,kind:string,text:string,digest:string,caption:string>"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of ``WIDTH``."""
    n = max(1, -(-len(data) // WIDTH)) * WIDTH
    return data + bytes(n - len(data))


def to_png(payload: bytes) -> bytes:
    """Greyscale PNG, 8 bits a sample, ``WIDTH`` samples a row; the payload is a positive multiple of it."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row after its filter type, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """Samples of a PNG that ``to_png`` wrote; checks every chunk's sum."""
    if not data.startswith(_PNG):
        raise ValueError("not a PNG")
    at, body, size = len(_PNG), [], (0, 0)
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)[:2]
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("unknown filter")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit average hash of an 8 x 8 reduction."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    cells = np.add.reduceat(x.astype(np.int64), np.arange(64) * len(x) // 64) / np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    bits = int("".join("1" if b else "0" for b in cells >= cells.mean()), 2)
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};hash={bits:016x}"


def parse_items(html: str) -> list[dict]:
    """Text blocks and media references of a page, in page order.

    A reference takes its caption from its figure's ``figcaption``, else from ``alt``.
    Media are ``img`` elements whose source is ``media:sha256:<digest>``; other images are not references.
    """
    items: list[dict] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    # an element with the figure that it stands in
    todo: list = [(_with_images(html), None)]
    captions: dict[int, str | None] = {}
    while todo:
        x, figure = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "img":
            if x.role.startswith(REFERENCE):
                flush()
                source, _, alt = x.role.partition("\n")
                if figure is not None and id(figure) not in captions:
                    captions[id(figure)] = _caption(figure)
                items.append({"kind": "media", "text": None, "digest": source[len(REFERENCE) :], "caption": captions.get(id(figure)) or alt or None})
        elif x.tag in ("script", "style", "head", "noscript", "template", "figcaption"):
            continue
        else:
            if x.tag in BLOCK:
                flush()
                todo.append((None, None))
            figure = x if x.tag == "figure" else figure
            todo.extend((k, figure) for k in reversed(x.kids))
    flush()
    return [{"pos": i, **x} for i, x in enumerate(items)]


def _caption(figure: Node) -> str | None:
    """Text of a figure's first caption, white space as one space."""
    for k in figure.kids:
        if not isinstance(k, str) and k.tag == "figcaption":
            todo, found = [k], []
            while todo:
                x = todo.pop()
                if isinstance(x, str):
                    found.append(x)
                else:
                    todo.extend(reversed(x.kids))
            return " ".join("".join(found).split())
    return None


_IMG = re.compile(r"<img\b((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.I)


def _with_images(html: str) -> Node:
    """The page's tree; an image carries its source and alternative text where other nodes carry a role."""

    def note(m: re.Match) -> str:
        a = attributes(m[1])
        return f'<img role="{escape(a.get("src", ""))}&#10;{escape(a.get("alt", ""))}">'

    return parse(_IMG.sub(note, html))


def parse_interleaved(pages: DataFrame, html_col: str = "html", name: str = "items", with_text: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Add the ordered items of each page: text blocks and media references as they stand in it.

    ``with_text=False`` leaves text blocks' strings null (their places stay).  Null or empty html has no items.  A
    column that is already called ``name`` is replaced.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() != name.lower()]

    def make():
        def f(html):
            rows = [parse_items(h) for h in str_texts(html)]
            if not with_text:
                for r in rows:
                    for x in r:
                        x["text"] = None
            kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
            return [pa.array(rows, kind)]

        return f

    return map_rows(pages, [html_col], [(name, T.ArrayType(T._parse_datatype_string(ITEM)))], make, keep=keep)


def store_media(payloads: DataFrame, column: str = "text", path: str | None = None) -> str:
    """Write the payloads (text as UTF-8, or bytes; null: empty) as media; returns the store's path.

    Rows: ``digest`` of the padded payload, ``media``.  A task stores a digest once; two tasks may both store it.
    """
    ship(payloads.sparkSession)
    path = path or new_path(payloads.sparkSession, "media")

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            names, media = [], []
            for x in byte_texts(b.column(0)):
                p = pad(x)
                d = hashlib.sha256(p)
                if d.digest() not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(d.digest())
                    names.append(d.hexdigest())
                    media.append(to_png(p))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    payloads.select(column).mapInArrow(run, "digest string, media binary").write.option("compression", "none").parquet(path)
    return path


def read_media(spark, path: str) -> DataFrame:
    """One row per digest, from the stored bytes: ``digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``."""

    def make():
        def f(media):
            out = []
            for m in media.cast(pa.binary()).to_pylist():
                p = from_png(m)
                out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), features(p)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]

        return f

    long, string = T.LongType(), T.StringType()
    added = [("payload_bytes", long), ("payload_sha256", string), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", string), ("feature", string)]
    rows = map_rows(spark.read.parquet(path), ["media"], added, make, keep=["digest"])
    return rows.groupBy("digest").agg(*[F.first(n).alias(n) for n, _ in added])


def resolve(sequences: DataFrame, media: DataFrame, items: str = "items", keep: list[str] | None = None) -> DataFrame:
    """Each media reference with what its digest names: the kept columns, ``pos, n_items, caption, digest`` and the media's columns (null if the store lacks the digest).

    Kept columns that have the name of one of these are left out.
    """
    taken = {c.lower() for c in ("pos", "n_items", "caption", "digest", *media.columns)}
    keep = [c for c in sequences.columns if c != items] if keep is None else keep
    (item,) = fresh(sequences, "_item")
    keep = [F.col(f"`{c}`") for c in keep if c.lower() not in taken]
    refs = sequences.select(*keep, F.size(items).alias("n_items"), F.explode(F.filter(items, lambda x: x["kind"] == "media")).alias(item))
    refs = refs.select(*keep, "n_items", *[F.col(f"{item}.{c}").alias(c) for c in ("pos", "caption", "digest")])
    return refs.join(media, "digest", "left")


def as_page(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pages that refer to their own text as a medium: ``doc_id, n_bytes, html``; null texts are empty.

    The text's lines are the page's paragraphs; the reference stands, with a caption that names its place, in the middle of them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.octet_length(text)
    padding = F.greatest(F.lit(WIDTH), F.ceil(n / WIDTH).cast("int") * WIDTH) - n
    digest = F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.repeat(F.lit("00"), padding))), 256)
    lines = F.split(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), "\n")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.cast("long").alias("n_bytes"), digest.alias("_digest"), lines.alias("_lines"))
    half = F.ceil(F.size("_lines") / 2).cast("int")
    before, after = F.slice("_lines", 1, half), F.slice("_lines", half + 1, F.size("_lines"))

    def paragraphs(part: Column) -> Column:
        return F.when(F.size(part) > 0, F.concat(F.lit("<p>"), F.array_join(part, "</p><p>"), F.lit("</p>"))).otherwise("")

    figure = F.format_string(f'<figure><img src="{REFERENCE}%s" alt=""><figcaption>After line %d of %d</figcaption></figure>', "_digest", half, F.size("_lines"))
    return rows.select("doc_id", "n_bytes", F.concat(F.lit("<article>"), paragraphs(before), figure, paragraphs(after), F.lit("</article>")).alias("html"))
