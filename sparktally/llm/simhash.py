"""SimHash near-dedup: segment-popcount embedding, grid range-join, exact check, components.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan
distance of two embeddings is at most the Hamming distance of the fingerprints, so points
more than 2 apart need no look. The grid's axes are five blocks of segments; two points
within 2 agree on three blocks at least, hence share one of ten grid cells. Pairs that share
a cell are held to the Manhattan bound, then to the Hamming distance itself.

Fingerprints of crowded cells are not paired: each puts out itself and its 64 one-bit
neighbours, and two of them are within 2 bits exactly if they put out a common value. So a
dense cluster costs rows in proportion to its size, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, materialise, scratch

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Segments of each block, 32 in all.
BLOCKS = (7, 7, 6, 6, 6)
#: Cells with more fingerprints than this are linked by common neighbours instead of pairs.
CROWDED = 24
EVEN = 0x5555555555555555


def fingerprint(text: str | None) -> int:
    """Majority vote over the XXH64 of all 3-word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(data, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - SHINGLE]]
    h = np.array([digest(data[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[at : at + (1 << 16)].astype(">u8"))
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(h))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the long columns of ``carry``: a signed 64-bit fingerprint for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *carry])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    return given.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *carry)))


def _long(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def embed(fp: Column) -> Column:
    """Bit counts 0, 1, 2 of the 32 segments, each in unary (00, 01, 11), so that bit counts of xor are Manhattan distances."""
    low, high = fp.bitwiseAND(_long(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(_long(EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def cell_masks() -> list[int]:
    """The bits of three of the five blocks, for each choice of three."""
    masks, at = [], 0
    for n in BLOCKS:
        masks.append(((1 << (2 * n)) - 1) << at)
        at += 2 * n
    return [a | b | c for a, b, c in combinations(masks, 3)]


def links(points: DataFrame, max_bits: int = MAX_BITS, crowded: int = CROWDED) -> DataFrame:
    """(a, b): enough pairs of distinct fingerprints within 2 bits to connect all that are so linked."""
    if max_bits != MAX_BITS:
        raise ValueError("the grid's ten cells are laid out for 2 bits")
    cells = F.array(*(F.struct(F.lit(i).alias("no"), F.col("at").bitwiseAND(_long(m)).alias("cell")) for i, m in enumerate(cell_masks())))
    grid = points.select("fp", embed(F.col("fp")).alias("at")).select("fp", "at", F.explode(cells).alias("c")).select("fp", "at", "c.no", "c.cell")
    w = Window.partitionBy("no", "cell")
    shared = materialise(grid.withColumn("n", F.count("*").over(w)).where("n > 1"), "cells")
    a, b = shared.where(F.col("n") <= crowded).alias("a"), shared.where(F.col("n") <= crowded).alias("b")
    near = (F.col("a.no") == F.col("b.no")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
    bound = F.bit_count(F.col("a.at").bitwiseXOR(F.col("b.at"))) <= max_bits
    pairs = a.join(b, near & bound).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct()
    dense = shared.where(F.col("n") > crowded).select("fp").distinct()
    around = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    spread = dense.select("fp", F.explode(around).alias("value"))
    w = Window.partitionBy("value")
    stars = spread.withColumn("least", F.min("fp").over(w)).where("least <> fp").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.union(stars)


def components(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of ``prints(doc_id, fp)``: the least fingerprint and the smallest id among all documents reachable."""
    with scratch() as tables:
        points = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
        roots = connected_components(links(points)).select(F.col("node").alias("fp"), "root")
        rooted = points.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        found = materialise(rooted.join(least, "root").select("fp", "root", "component_id"), "components")
        tables.keep(found)
    return found


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like any other. component_id is the
    smallest id of the component; null ids do not count, and it is null where all are.
    Repeated rows are rows like others; other columns are not read; an empty table comes back empty.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    of = components(prints)
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group: the smallest id, null ids last, then the least hashes of the text and of the row.

    Groups are told apart by their fingerprints, not by ids: a group without ids leaves one
    row, and an id with texts in two groups may stand for both. Map columns are not hashed.
    """
    cols = docs.columns
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    # nulls do not change a hash, so where they are is hashed as well
    row = F.xxhash64(*hashed, *(F.col(c).isNull() for c in hashed))
    d = docs.withColumns({"_th": F.xxhash64(F.col(text_col)), "_row": row})
    with scratch() as tables:
        prints = materialise(fingerprints(d, id_col, text_col, ("_th", "_row")), "fingerprints")
        of = components(prints)
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_th", "_row")
        keep = prints.join(of.select("fp", "root"), "fp").groupBy("root").agg(F.min(place).alias("first")).select("first._th", "first._row")
        keep = materialise(keep, "kept")
        tables.keep(keep)
    discard(of)
    return d.join(keep, ["_th", "_row"], "left_semi").dropDuplicates(["_th", "_row"]).select(*cols)
