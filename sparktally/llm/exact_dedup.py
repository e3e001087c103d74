"""Exact dedup by Grace hashing: partition by content hash, spill, recurse, compare whole contents.

Two levels keep hot groups harmless. Each input task first folds its own copies with a
bounded table, so a group holding a third of all rows crosses the shuffle as one record per
task and not one per row. The reducers then run the Grace scheme over those records: an
open-addressing table while a bucket fits, else spill files by fresh hash bits, recursively.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLANK = b" \t\n\x0b\x0c\r"
FLUSH_BYTES = 32 << 20
FLUSH_ROWS = 20_000
TABLE_BYTES = 96 << 20
FAN_OUT = 16


def normalise(data: bytes) -> bytes:
    """Every run of ASCII white space becomes one space."""
    words = data.split()
    if not words:
        return b" " if data else b""
    return (b" " if data[:1] in BLANK else b"") + b" ".join(words) + (b" " if data[-1:] in BLANK else b"")


class ContentTable:
    """Open addressing with linear probing; a hit needs equal hash and equal complete content."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.held = 0

    def find(self, h: int, content: bytes) -> tuple[int, bool]:
        """The content's number, and whether it is new."""
        slots, hashes, contents = self.slots, self.hashes, self.contents
        mask = len(slots) - 1
        at = h & mask
        while (k := slots[at]) >= 0:
            if hashes[k] == h and contents[k] == content:
                return k, False
            at = (at + 1) & mask
        slots[at] = k = len(contents)
        hashes.append(h)
        contents.append(content)
        self.held += len(content) + 120
        if 5 * len(contents) > 3 * len(slots):
            self._grow()
        return k, True

    def _grow(self) -> None:
        self.slots = slots = array("q", [-1]) * (4 * len(self.slots))
        mask = len(slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = k


LOCAL = pa.schema(
    [("row_key", pa.int64()), ("rep_key", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("bucket", pa.int64()), ("content", pa.binary()), ("min_id", pa.int64()), ("min_row", pa.int64()), ("n", pa.int64())]
)
LOCAL_DDL = "row_key long, rep_key long, doc_id long, text_sha256 string, bucket long, content binary, min_id long, min_row long, n long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _order(doc_id: int | None, row: int) -> tuple:
    """Null ids come last, then rows in input order."""
    return (doc_id is None, doc_id or 0, row)


def fold_locally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows and fold equal contents within bounded runs of them; one row of each carries the content."""
    row = TaskContext.get().partitionId() << 36
    table, rows, info = ContentTable(), [], []

    def flush():
        out = {name: [] for name in LOCAL.names}
        first = [r[2] for r in info]
        for key, doc_id, k, digest in rows:
            rep = first[k]
            least, n, _ = info[k]
            own = rep == key
            values = (key, rep, doc_id, digest, _signed(table.hashes[k]), table.contents[k] if own else None, None if least[0] else least[1], least[2], n)
            for name, v in zip(LOCAL.names, values, strict=True):
                out[name].append(v)
        return pa.RecordBatch.from_pydict(out, LOCAL)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            content = normalise((text.as_py() or "").encode())
            k, new = table.find(xxhash.xxh3_64_intdigest(content), content)
            order = _order(doc_id, row)
            if new:
                info.append([order, 1, row])
            else:
                info[k][0] = min(info[k][0], order)
                info[k][1] += 1
            rows.append((row, doc_id, k, hashlib.sha256(content).hexdigest()))
            row += 1
            if table.held > FLUSH_BYTES or len(rows) >= FLUSH_ROWS:
                yield flush()
                table, rows, info = ContentTable(), [], []
    if rows:
        yield flush()


HEAD = "<q?qqqI"
GROUPS = pa.schema([("rep_key", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
GROUPS_DDL = "rep_key long, keep_id long, keep_row long, group_size long"
CHUNK = 50_000


def grace(records: Iterator[tuple], level: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Groups of equal content among (rep_key, no_id, min_id, min_row, n, content).

    While the distinct contents fit the budget they stay in one table; beyond it, everything
    goes to FAN_OUT spill files by hash bits of this level and each file is treated alike.
    The files live in the task's own scratch folder and go with it.
    """
    table, info, members, spill, folder = ContentTable(), [], [], None, None
    try:
        for rec in records:
            rep, no_id, min_id, min_row, n, content = rec
            if spill is None:
                k, new = table.find(xxhash.xxh3_64_intdigest(content, seed=level + 1), content)
                order = (no_id, min_id, min_row)
                if new:
                    info.append([order, n])
                else:
                    info[k][0] = min(info[k][0], order)
                    info[k][1] += n
                members.append((rep, k, no_id, min_id, min_row, n))
                if table.held <= budget or len(info) < 2:
                    continue
                folder = tempfile.TemporaryDirectory()
                spill = [open(f"{folder.name}/{i}", "w+b") for i in range(FAN_OUT)]
                for rep, k, no_id, min_id, min_row, n in members:
                    _spill(spill, table.hashes[k], (rep, no_id, min_id, min_row, n, table.contents[k]))
                table, info, members = ContentTable(), [], []
            else:
                _spill(spill, xxhash.xxh3_64_intdigest(content, seed=level + 1), rec)
        if spill is not None:
            for f in spill:
                f.seek(0)
                yield from grace(_unspill(f), level + 1, budget)
                f.close()
            return
        for i in range(0, len(members), CHUNK):
            part = members[i : i + CHUNK]
            keep = [info[m[1]] for m in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in part], pa.int64()), pa.array([None if o[0] else o[1] for o, _ in keep], pa.int64()), pa.array([o[2] for o, _ in keep], pa.int64()), pa.array([n for _, n in keep], pa.int64())],
                schema=GROUPS,
            )
    finally:
        if folder is not None:
            folder.cleanup()


def _spill(files: list, h: int, rec: tuple) -> None:
    f = files[(h >> 40) % FAN_OUT]
    f.write(struct.pack(HEAD, *rec[:5], len(rec[5])))
    f.write(rec[5])


def _unspill(f) -> Iterator[tuple]:
    while head := f.read(struct.calcsize(HEAD)):
        *rec, size = struct.unpack(HEAD, head)
        yield (*rec, f.read(size))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are, after white-space normalisation (null counts as
    empty). The row with the smallest id stays; null ids rank last (keep_id is null only if
    no row of the group has an id), and of rows repeated under one id the first read stays.
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    local = materialise(src.mapInArrow(fold_locally, LOCAL_DDL), "exact")
    reps = local.where(F.col("content").isNotNull()).select("bucket", "rep_key", F.col("min_id").isNull().alias("no_id"), F.coalesce("min_id", F.lit(0)).alias("min_id"), "min_row", "n", "content").repartition("bucket")

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                cols = [b.column(i).to_pylist() for i in range(1, 6)]
                for i, content in enumerate(b.column(6)):
                    yield (*(c[i] for c in cols), content.as_py())

        yield from grace(records(), 0, table_bytes)

    groups = reps.mapInArrow(reduce, GROUPS_DDL)
    return (
        local.select("row_key", "rep_key", "doc_id", "text_sha256")
        .join(groups, "rep_key")
        .select("doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), "text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one per distinct id among the kept ids of :func:`exact_groups`."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_keep"))
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("_keep")), "left_semi")
