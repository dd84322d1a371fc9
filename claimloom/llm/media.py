"""Media columns: interleaved sequences of text and media, with payloads kept by digest.

A media store is a table of (digest, media), one stored form per digest at least.  Parsing
HTML gives each document's ordered items; a media item holds its place, its caption and the
digest that its reference names.  Resolving joins items to the store by digest, so places
and captions stay where they were.  A stored form is a binary PGM picture: a short header
and the payload as rows of 8-bit samples, so nothing is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, map_arrow, materialize, salted_join

UNIT = 64
#: A reference into the store: this, then the stored form's SHA-256 in hex.
SCHEME = "media:sha256-"
ITEM = "array<struct<place:int,kind:string,text:string,ref:string,digest:string,caption:string>>"
FIELDS = ("place", "kind", "text", "ref", "digest", "caption")
#: Tags that part text, and those whose content is no text (fixed values).
BREAKS = frozenset("address article aside blockquote body br dd div dl dt figure figcaption footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style template".split())
SOURCES = frozenset("img video audio source embed".split())


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def encode_pgm(payload: bytes, width: int = UNIT) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def decode_pgm(media: bytes) -> np.ndarray:
    """The samples of a binary PGM picture with 8 bits each, row by row."""
    kind, size, top, data = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or top != b"255" or len(data) != width * height:
        raise ValueError("not a binary PGM picture of 8 bits")
    return np.frombuffer(data, np.uint8).reshape(height, width)


def average_hash(samples: np.ndarray) -> str:
    """Size, and a 64-bit picture of which of 8 by 8 areas are brighter than the mean."""
    height, width = samples.shape
    rows = np.add.reduceat(samples.astype(np.int64), np.unique(np.arange(8) * height // 8), axis=0)
    cells = np.add.reduceat(rows, np.arange(8) * width // 8, axis=1)
    cells = cells[np.arange(8) * len(cells) // 8]
    bits = (cells * cells.size > cells.sum()).ravel()
    return f"{width}x{height}:{int(''.join('1' if b else '0' for b in bits), 2):016x}:{int(samples.sum())}"


class _Figure:
    """An open figure: its media, its captions as text items, and the caption that is open."""

    def __init__(self) -> None:
        self.media: list[dict] = []
        self.captions: list[dict] = []
        self.caption: list[str] | None = None


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.hidden: list[str] = []
        self.figures: list[_Figure] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.add_text(text)

    def add_text(self, text: str) -> dict:
        self.items.append({"kind": "text", "text": text, "ref": None, "digest": None, "caption": None})
        return self.items[-1]

    def end_caption(self) -> None:
        figure = self.figures[-1]
        if figure.caption is not None:
            figure.captions[-1]["text"] = " ".join("".join(figure.caption).split())
            figure.caption = None

    def end_figure(self) -> None:
        """A figure's captions are its media's; without media they stay texts, where they were."""
        self.end_caption()
        figure = self.figures.pop()
        if figure.media:
            said = " ".join(c["text"] for c in figure.captions if c["text"])
            for item in figure.media:
                item["caption"] = said or item["caption"]
            for caption in figure.captions:
                caption["text"] = ""

    def finish(self) -> list[dict]:
        """All items in order, also of what the page left open: a template without an end hides nothing."""
        self.close()
        if self.silent:
            self.silent = 0
            self.handle_data("".join(self.hidden))
        self.flush()
        while self.figures:
            self.end_figure()
        kept = [i for i in self.items if i["kind"] == "media" or i["text"]]
        return [{"place": k, **item} for k, item in enumerate(kept)]

    def handle_starttag(self, tag, attrs) -> None:
        named = dict(attrs)
        if tag in SILENT:
            self.silent += 1
        if tag in BREAKS:
            self.flush()
        if tag == "figure":
            self.figures.append(_Figure())
        elif tag == "figcaption" and self.figures:  # one outside a figure is text
            self.end_caption()
            self.figures[-1].caption = []
            self.figures[-1].captions.append(self.add_text(""))
        if tag in SOURCES and named.get("src"):
            self.flush()
            ref = named["src"].strip()
            digest = ref.removeprefix(SCHEME).lower() if ref.startswith(SCHEME) else hashlib.sha256(ref.encode()).hexdigest()
            self.items.append({"kind": "media", "text": None, "ref": ref, "digest": digest, "caption": named.get("alt") or None})
            if self.figures:
                self.figures[-1].media.append(self.items[-1])

    def handle_endtag(self, tag) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
            if not self.silent:
                self.hidden = []
        if tag in BREAKS:
            self.flush()
        if tag == "figcaption" and self.figures:
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data) -> None:
        if self.silent:
            if self.cdata_elem is None:  # what a script or style holds is never text
                self.hidden.append(data)
        else:
            caption = self.figures[-1].caption if self.figures else None
            (self.text if caption is None else caption).append(data)


def parse_items(html: str | None) -> list[dict]:
    """A page's texts and media references in order; a null or empty page has none."""
    parser = _Items()
    parser.feed(html or "")
    return parser.finish()


def interleave(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace ``html`` by ``items``, an array of (place, kind, text, ref, digest, caption).

    Malformed HTML is read as far as it goes.  Other columns and repeated rows stay.
    """
    others = [c for c in pages.columns if c not in (html, "items")]
    rows = pages.select(*others, html)
    kind = pa.list_(pa.struct([("place", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "ref", "digest", "caption"))]))

    def parse(batches):
        for batch in batches:
            items = pa.array([parse_items(h) for h in batch.column(len(others)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], items], [*others, "items"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != html) + f"items {ITEM}"
    return map_arrow(rows, parse, schema)


def resolve(sequences: DataFrame, store: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per item, in no order, with the store's columns of its digest (null if it has none).

    ``store`` has one row per digest.  Digests that very many items name are dealt out.  Columns of
    ``sequences`` and then of ``store`` that are named like an item's (``place, kind, text, ref, digest,
    caption``) give way to the item's; a column of both tables is the store's.
    """
    found = [c for c in store.columns if c == "digest" or c not in FIELDS]
    store = store.select(*found)
    others = [c for c in sequences.columns if c != "items" and c not in FIELDS and c not in found]
    hold = F.col(key).alias("_key") if key in sequences.columns else F.xxhash64("items").alias("_key")
    items = sequences.select(*others, hold, F.explode("items").alias("item")).select(*others, "_key", "item.*")
    named = items.groupBy("digest").agg(F.count("*").alias("n"))
    named = materialize(named.where("digest IS NOT NULL"), "media-named")
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # texts have no digest; they are dealt by their document and match nothing
    items = items.withColumn("digest", F.coalesce("digest", F.concat(F.lit("none "), F.coalesce(F.col("_key").cast("string"), F.lit("")), F.lit(" "), F.col("place"))))
    out = salted_join(items, store, "digest", hot_keys(named, "digest", "n", total), F.xxhash64("_key", "place"), "left")
    return out.withColumn("digest", F.when(F.col("kind") == "media", F.col("digest"))).drop("_key")


def store_texts(docs: DataFrame) -> DataFrame:
    """Write each text as a picture with the page that shows it: doc_id, n_bytes, digest, media, html.

    The table is in the shared folder; ``html`` tells the text's first words and refers to
    the picture by digest.
    """

    def write(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                media = encode_pgm(pad(text or b""))
                digest = hashlib.sha256(media).hexdigest()
                title = escape((text or b"")[:40].decode("utf-8", "ignore"))
                for col, v in zip(cols, (len(text or b""), digest, media, f'<article><p>{title}</p><figure><img src="{SCHEME}{digest}" alt="text"><figcaption>{len(text or b"")} bytes</figcaption></figure></article>'), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True))], ["doc_id", "n_bytes", "digest", "media", "html"])

    return materialize(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), write, "doc_id long, n_bytes long, digest string, media binary, html string"), "media-store")


def features(store: DataFrame, decode: Callable[[bytes], np.ndarray] = decode_pgm) -> DataFrame:
    """Read the stored bytes back: one row per digest with the digests of payload and media and the feature.

    Media stay where they are; only their few derived values are shuffled.
    """

    def read(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for media in batch.column(1).to_pylist():
                samples = decode(media)
                payload = samples.tobytes()
                for col, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), average_hash(samples)), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["digest", *FEATURES])

    rows = map_arrow(store.select("digest", "media"), read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    # equal digests have equal values, so any row of a digest is as good as another
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in FEATURES])


FEATURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    store = store_texts(docs)
    found = materialize(features(store), "media-features")
    sequences = materialize(interleave(store.select("doc_id", "n_bytes", "html")), "media-sequences")
    shown = resolve(sequences, found).where("kind = 'media'")
    return shown.select("doc_id", "n_bytes", *FEATURES, F.col("place").alias("item_place"), "caption")
