"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of text and media-reference structs; references name
payloads by digest, a join on the digest resolves them, and positions and captions stay with
their reference. Payloads are stored as 8-bit grey images (PGM), a byte a sample.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WIDTH = 64
SCHEME = "sha256:"
MEDIA_TAGS = {"img", "video", "audio", "source", "embed"}
SILENT_TAGS = {"script", "style", "template", "noscript"}
#: Tags that do not end a run of text.
INLINE_TAGS = {"a", "abbr", "b", "cite", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u", "wbr"}
ITEM_DDL = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"


class Interleaver(HTMLParser):
    """Collects items in reading order; a figure's caption goes to every medium of that figure."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.parts: list[str] = []
        self.silent = 0
        self.figures: list[list] = []
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = "".join(self.parts)
        self.parts = []
        if text.strip():
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT_TAGS:
            self.silent += 1
        if tag not in INLINE_TAGS and self.caption is None:
            self._flush()
        if tag == "figure":
            self.figures.append([])
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA_TAGS:
            a = dict(attrs)
            if a.get("src"):
                item = {"kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt") or a.get("title")}
                self.items.append(item)
                if self.figures:
                    self.figures[-1].append(item)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = "".join(self.caption).strip(), None
            if self.figures:
                self.figures[-1].append(said)
            elif said:
                self.parts.append(said)
                self._flush()
        elif tag == "figure" and self.figures:
            found = self.figures.pop()
            said = " ".join(x for x in found if isinstance(x, str))
            for x in found:
                if not isinstance(x, str) and said:
                    x["caption"] = said
        if tag not in INLINE_TAGS and self.caption is None:
            self._flush()

    def handle_data(self, data):
        if self.silent:
            return
        (self.parts if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """Items of one document; none for null or empty HTML. Broken markup never raises."""
    p = Interleaver()
    p.feed(html or "")
    p.close()
    p._flush()
    return [{"position": i, **x} for i, x in enumerate(p.items)]


ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, items): every row's sequence of text and media structs. Null HTML gives an empty sequence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse_html(h) for h in b.column(1).to_pylist()], ITEM)], names=["doc_id", "items"])

    return pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"doc_id long, items {ITEM_DDL}")


def padded(text: Column) -> Column:
    """The text's UTF-8 bytes with zero bytes up to a positive multiple of WIDTH."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(data)
    fill = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), fill.cast("int"))))


def as_pgm(payload: Column) -> Column:
    """An 8-bit grey image, WIDTH samples a row."""
    rows = (F.octet_length(payload) / WIDTH).cast("long").cast("string")
    return F.concat(F.concat(F.lit(f"P5\n{WIDTH} "), rows, F.lit("\n255\n")).cast("binary"), payload)


def pgm_samples(stored: bytes) -> np.ndarray:
    """Rows of samples of a stored image."""
    magic, size, top, body = stored.split(b"\n", 3)
    width, rows = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(body) != width * rows:
        raise ValueError("not an 8-bit grey image of its stated size")
    return np.frombuffer(body, np.uint8).reshape(rows, width)


STORED_DDL = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_features(store: DataFrame) -> DataFrame:
    """Reads (digest, media) rows back and describes each image; one row per digest."""
    fields = [("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                media = media.as_py()
                image = pgm_samples(media)
                payload = image.tobytes()
                tenths = np.bincount(image.ravel() >> 4, minlength=16)
                feature = f"{image.shape[1]}x{image.shape[0]} sum={int(image.sum(dtype=np.int64))} top={int(image.max())} hist={'-'.join(map(str, tenths))}"
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)] if rows else [pa.array([], t) for _, t in fields], schema=schema)

    return store.mapInArrow(run, STORED_DDL).dropDuplicates(["digest"])


def resolve(items: DataFrame, store: DataFrame) -> DataFrame:
    """A row per media reference: doc_id, position, caption and what its digest leads to (null where nothing is stored)."""
    refs = items.select("doc_id", F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("m"))
    refs = refs.select("doc_id", F.col("m.position").alias("position"), F.col("m.caption").alias("caption"), F.regexp_extract("m.ref", f"^{SCHEME}([0-9a-f]{{64}})$", 1).alias("digest"))
    return refs.join(store, "digest", "left")


def sequences(items: DataFrame, store: DataFrame) -> DataFrame:
    """(doc_id, items): every sequence of ``items(doc_id, items)`` whole and in order, each medium with what its digest leads to.

    ``found`` holds the columns of ``store`` beside its digest; it is null for text and where
    nothing is stored. Only references are joined, texts stay where they are; ids may be null
    or repeated, sequences empty, and an empty table comes back empty.
    """
    rows = materialise(items.select(F.monotonically_increasing_id().alias("row"), "doc_id", "items"), "sequences")
    refs = rows.select("row", F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("m"))
    refs = refs.select("row", F.col("m.position").alias("position"), F.regexp_extract("m.ref", f"^{SCHEME}([0-9a-f]{{64}})$", 1).alias("digest"))
    found = F.struct(*(c for c in store.columns if c != "digest"))
    per_row = refs.join(store.select("digest", found.alias("found")), "digest").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("position", "found"))).alias("_found"))
    fields = ("position", "kind", "text", "ref", "caption")
    filled = F.transform("items", lambda x: F.struct(*(x[f].alias(f) for f in fields), F.try_element_at("_found", x["position"]).alias("found")))
    return rows.join(per_row, "row", "left").select("doc_id", filled.alias("items"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as an interleaved page: its words, then a figure holding the text's bytes as an image.

    The images are written to a store in the shared folder and read back; the pages are
    parsed and their references resolved against the store. One row per input row; a null
    text is empty; ids may be null or repeated; rows of equal text share one stored digest; an
    empty table comes back empty.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    payload = padded(F.col("text"))
    store = materialise(d.select(F.sha2(payload, 256).alias("digest"), as_pgm(payload).alias("media")), "media")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("string")
    html = F.concat(F.lit("<p>"), escaped(F.coalesce("text", F.lit(""))), F.lit(f'</p><figure><img src="{SCHEME}'), F.sha2(payload, 256), F.lit('"><figcaption>'), n_bytes, F.lit(" bytes</figcaption></figure>"))
    pages = d.select("doc_id", html.alias("html"))
    # only the references go on; the texts of the items end here
    # written, so that the join's rows of a digest that many texts share may be split
    found = resolve(interleave(pages, "doc_id", "html"), materialise(stored_features(store), "features"))
    return found.select("doc_id", F.split("caption", " ")[0].cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
