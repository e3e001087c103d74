"""Suffix-array dedup: removal of long strings that also start elsewhere.

Dense prefix doubling keeps a row for every byte through every round. Here only sampled
positions are ranked, and the sampling loses nothing: every 400-byte window is represented
by the 100-byte gram with the least hash inside it, so two equal windows are represented at
the same offset. As in prefix doubling, Spark groups and sorts positions by pairs of ranks of
growing strings around them and drops those that become unique:

  1. gram (100 bytes)           x  hull (all windows the gram represents)
  2. core of 16 windows (385)   x  hull of those windows (up to 415)
  3. single windows (400), exact

A hull met twice settles all its windows as repeated; a unique gram or core settles them as
unique; only what is undecided goes on, together with one witness of each settled hull that
shares a gram or core with it. Ranks are 64-bit content hashes, always used in pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialise, small_side

WINDOW = 400
GRAM = 100
BLOCK = 16
#: Windows looked at together; longer texts are taken in overlapping stretches.
STRETCH = 1 << 19
POSITION_BITS = 20

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


class Sampler:
    """The representative of every window of a text, by a rolling hash and a sliding minimum."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM) -> None:
        self.window, self.gram = window, gram
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) >= n:
            return
        size = max(n, 2 * len(self.power))
        for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def _stretch(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each run of windows with one representative: its position, the run's first window."""
        n, k, w = len(b), self.gram, self.window - self.gram + 1
        self._powers(n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * self.power[:n], out=prefix[1:])
        h = (prefix[k:] - prefix[:-k]) * self.inverse[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = (h & ~np.uint64((1 << POSITION_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        full = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        full[: len(h)] = h
        rows = full.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = np.minimum(behind[: n - self.window + 1], ahead[w - 1 : w + n - self.window]) & np.uint64((1 << POSITION_BITS) - 1)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return at[first].astype(np.int64), first

    def representatives(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(position, first window, last window)."""
        b = np.frombuffer(data, np.uint8)
        for c in range(0, len(b) - self.window + 1, STRETCH):
            part = b[c : c + STRETCH + self.window - 1]
            at, first = self._stretch(part)
            last = np.append(first[1:], len(part) - self.window + 1) - 1
            yield from zip((at + c).tolist(), (first + c).tolist(), (last + c).tolist(), strict=True)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


_hash = xxhash.xxh3_64_intdigest
ROWS = pa.schema([("core", pa.int64()), ("hull", pa.int64()), ("rid", pa.int64()), ("at", pa.int32()), ("x1", pa.int32()), ("x2", pa.int32())])
ROWS_DDL = "core long, hull long, rid long, at int, x1 int, x2 int"
FLUSH = 100_000


def _rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in found:
        out.append(row)
        if len(out) >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ROWS.types)], schema=ROWS)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ROWS.types)], schema=ROWS)


def _ranked(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settled, open, the table of both) of rows(core, hull, rid, at, x1, x2): repeated hulls; undecided rows with their witnesses.

    Counts are combined before each shuffle. What is joined by core was written before, so that
    Spark may split a hot core's rows, or broadcast the other side where its count allows it.
    """
    often = materialise(rows.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), name + "-cores")
    alive = materialise(rows.join(small_side(often), "core", "left_semi"), name)
    discard(rows, often)
    hulls = alive.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min(F.struct("rid", "x1")).alias("one"))
    hulls = materialise(hulls, name + "-hulls")
    mixed = materialise(hulls.groupBy("core").agg(F.max(F.col("n") == 1).alias("mixed")), name + "-mixed")
    told = alive.join(hulls.join(small_side(mixed), "core"), ["core", "hull"])
    go = F.col("mixed") & ((F.col("n") == 1) | (F.col("one") == F.struct("rid", "x1")))
    told = materialise(told.where((F.col("n") > 1) | go).select("rid", "at", "x1", "x2", (F.col("n") > 1).alias("settled"), go.alias("open")), name + "-told")
    discard(alive, hulls, mixed)
    return told.where("settled"), told.where("open"), told


def _lists(rows: DataFrame) -> DataFrame:
    """A row per text with its open positions; as many as the text has at most."""
    return rows.groupBy("rid").agg(F.collect_list(F.struct("at", "x1", "x2")).alias("todo"))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and what is left as text (without characters that were cut).

    Bytes covered by a ``window``-byte string that also starts anywhere else are removed,
    judged on the input. Null and empty texts, and texts shorter than the window, lose
    nothing. Repeated rows count as occurrences of their own. Rows are followed by a 64-bit
    hash of id and text; other columns are not read.
    """
    if not gram <= window - BLOCK:
        raise ValueError("gram must leave room for a block of windows")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("rid", F.xxhash64(F.col("doc_id"), "text"))

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(window, gram)

        def found():
            for b in batches:
                for rid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    data = text.as_py().encode()
                    for at, x1, x2 in sampler.representatives(data):
                        yield _signed(_hash(data[at : at + gram])), _signed(_hash(data[x1 : x2 + window], (at - x1) << 32 | (at - x2))), rid, at, x1, x2

        yield from _rows(found())

    long_enough = src.where(F.octet_length("text") >= window)
    rows = materialise(long_enough.select("rid", "text").mapInArrow(sample, ROWS_DDL), "grams")
    settled1, open1, told1 = _ranked(rows, "grams")
    touched = settled1.select("rid").union(open1.select("rid")).distinct()
    texts = materialise(long_enough.join(small_side(touched), "rid", "left_semi").select("rid", "doc_id", "text"), "texts")
    bodies = texts.select("rid", "text")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for b in batches:
                for rid, text, todo in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    data = text.as_py().encode()
                    for row in todo.as_py():
                        at, low, high = row["at"], row["at"] - row["x2"], row["at"] - row["x1"]
                        for i in range(low // BLOCK, high // BLOCK + 1):
                            far = BLOCK * i + BLOCK - 1
                            a, z = max(low, BLOCK * i), min(high, far)
                            core = data[at - BLOCK * i : at - far + window]
                            yield _signed(_hash(core, i + 1)), _signed(_hash(data[at - z : at - a + window], z << 32 | a)), rid, at, at - z, at - a

        yield from _rows(found())

    def single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for b in batches:
                for rid, text, todo in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    data = text.as_py().encode()
                    for row in todo.as_py():
                        for x in range(row["x1"], row["x2"] + 1):
                            part = data[x : x + window]
                            yield _signed(_hash(part, row["at"] - x)), _signed(_hash(part, 1 << 40)), rid, row["at"], x, x

        yield from _rows(found())

    rows2 = materialise(bodies.join(_lists(open1), "rid").select("rid", "text", "todo").mapInArrow(blocks, ROWS_DDL), "blocks")
    settled2, open2, told2 = _ranked(rows2, "blocks")
    rows3 = materialise(bodies.join(_lists(open2), "rid").select("rid", "text", "todo").mapInArrow(single, ROWS_DDL), "windows")
    again = rows3.groupBy("core", "hull").agg(F.count("*").alias("n")).where("n > 1").select("core", "hull")
    settled3 = rows3.join(again, ["core", "hull"], "left_semi")
    spans = settled1.select("rid", "x1", "x2").union(settled2.select("rid", "x1", "x2")).union(settled3.select("rid", "x1", "x2"))
    spans = materialise(spans.groupBy("rid").agg(F.collect_set(F.struct("x1", "x2")).alias("spans")), "spans")
    discard(told1, told2, rows3, texts)
    size = spans.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b, out = whole.slice(at, 500), []
                for doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    text, runs = text.as_py(), []
                    data = text.encode()
                    for s in sorted((s["x1"], s["x2"] + window) for s in spans.as_py() or ()):
                        if runs and s[0] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], s[1])
                        else:
                            runs.append(list(s))
                    kept = b"".join(data[s:e] for s, e in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(data)])) if runs else data
                    out.append((doc_id, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if runs else text))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    d = src.join(F.broadcast(spans) if size <= BROADCAST_ROWS else spans, "rid", "left")
    return d.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
