"""The trie of conversation prefixes, laid out in preorder so that a subtree is an interval.

Turns. Conversations are rebuilt from a shared base and their own turns. Every turn hashes
with its position to 128 bits and a prefix's digest is the xor of its turns' hashes, so
prefix digests are running aggregates; equal digests make one node. No conversation is
gathered: rows are dealt by ranges of (conversation, turn), running values go on within
each range, and the few conversations that cross ranges get what the earlier ranges hold.

Order. A node is a head where its parent has several children or another smallest member;
the heads of a path name all its turns off, and a chain of nodes below a head without other
heads is a run. Runs sort by the digests of the heads on their path: a prefix sorts before
what extends it, which is preorder. A path with k heads needs k different conversations
that leave it, with turns up to there, so all paths together are about as long as the input.

Sums. A run's nodes take consecutive places, its subtree ends at its start plus the size of
all runs whose path extends its own. Leaves and saved tokens of a subtree are differences
of prefix sums over the places, built from blocks of places, of blocks, and so on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch

BASE_EVERY = 20
LONGEST_SHARED = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Places of one block of a prefix sum; also ids that are joined to one piece before hashing.
BLOCK = 1 << 16
PIECE = 4096


def _in_ranges(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` dealt by ranges of ``order`` as a table, with the range's number as ``part``."""
    return materialise(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def _before(df: DataFrame, key: str, value: Column, zero: Column, total) -> DataFrame:
    """(part, key, carry): for keys in several ranges, the sum of ``value`` over earlier ranges.

    At most the first and last key of a range go on elsewhere, so there are fewer than two
    rows a range, which is a proven bound for broadcasting.
    """
    ends = df.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    edge = ends.select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias(key))
    crossing = edge.withColumn("parts", F.count("*").over(Window.partitionBy(key))).where("parts > 1").select("part", key)
    held = df.join(F.broadcast(crossing), ["part", key]).groupBy("part", key).agg(total(value).alias("carry"))
    w = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return held.select("part", key, F.coalesce(total("carry").over(w), zero).alias("carry"))


def base_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, base): the first turns of conversations that others may share, in order."""
    w = Window.partitionBy("conv_id").orderBy(*_turn_order())
    first = turns.where(F.col("conv_id") % BASE_EVERY == 0).withColumn("i", F.row_number().over(w)).where(F.col("i") <= LONGEST_SHARED)
    turn = F.struct("i", *_hashes(F.col("i")), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    return first.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("base"))


def _turn_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def _hashes(at: Column) -> list[Column]:
    at = at.cast("long")
    return [F.xxhash64(F.lit(salt), at, "role", "text").alias(name) for salt, name in ((1, "ha"), (2, "hb"))]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, rows): a row per conversation with its number of rebuilt turns, and a row per
    rebuilt turn: conv_id, i, len, the digests da, db of the prefix that ends there and pa, pb of the one before, words.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).where("conv_id is not null")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = base_turns(turns).withColumnRenamed("conv_id", "b")
    shared = own.withColumns({"b": F.col("conv_id") - F.col("conv_id") % BASE_EVERY, "h": (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")})
    shared = shared.join(base, "b", "left").withColumn("base", F.when(F.col("base").isNull() | (F.col("h") == 0), F.expr("slice(base, 1, 0)")).otherwise(F.expr("slice(base, 1, greatest(h, 1))")))
    k = F.coalesce(F.size("base"), F.lit(0))
    xor = lambda c: F.aggregate(F.coalesce(F.transform("base", lambda t: t[c]), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    convs = shared.select("conv_id", "n", "h", F.when(F.col("base").isNull(), 0).otherwise(k).alias("k"), xor("ha").alias("xa"), xor("hb").alias("xb"), "base")
    convs = materialise(convs.withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")

    with scratch() as tables:
        # turns from the base: three at most, so running values are sums over slices
        upto = lambda c, i: F.aggregate(F.slice("base", 1, i), F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(t[c]))
        taken = convs.where("k > 0").select("conv_id", "len", "base", F.posexplode("base").alias("at", "t"))
        first = taken.select("conv_id", (F.col("at") + 1).cast("long").alias("i"), "len", *(upto(h, F.col("at") + 1).alias(d) for h, d in (("ha", "da"), ("hb", "db"))), F.col("t.ha").alias("ha"), F.col("t.hb").alias("hb"), F.col("t.words").alias("words"))

        # the conversation's own turns after its first h
        # equal rows may be told apart by any number: whichever comes first, the prefixes are the same
        placed = _in_ranges(turns.withColumn("row", F.monotonically_increasing_id()), "turns", F.col("conv_id"), *_turn_order(), F.col("row")).drop("row")
        carried = placed.withColumn("nth", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*_turn_order())))
        carried = carried.join(F.broadcast(_before(placed, "conv_id", F.lit(1), F.lit(0), F.sum)), ["part", "conv_id"], "left")
        at = carried.select("part", "conv_id", "turn", "role", "text", (F.col("nth") + F.coalesce("carry", F.lit(0))).alias("nth"))
        late = at.join(convs.select("conv_id", "h", "k", "len", "xa", "xb"), "conv_id").where("nth > h")
        i = (F.col("nth") - F.col("h") + F.col("k")).cast("long")
        hashed = materialise(late.select("part", "conv_id", i.alias("i"), "len", "xa", "xb", *_hashes(i), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "own-turns")
        w = Window.partitionBy("part", "conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        runs = hashed.withColumns({"ra": F.bit_xor("ha").over(w), "rb": F.bit_xor("hb").over(w)})
        for x, h in (("a", "ha"), ("b", "hb")):
            runs = runs.join(F.broadcast(_before(hashed, "conv_id", F.col(h), F.lit(0).cast("long"), F.bit_xor).withColumnRenamed("carry", f"c{x}")), ["part", "conv_id"], "left")
        d = lambda x: F.col(f"r{x}").bitwiseXOR(F.coalesce(f"c{x}", F.lit(0).cast("long"))).bitwiseXOR(F.col(f"x{x}"))
        rest = runs.select("conv_id", "i", "len", d("a").alias("da"), d("b").alias("db"), "ha", "hb", "words")
        rows = first.union(rest).withColumns({"pa": F.col("da").bitwiseXOR(F.col("ha")), "pb": F.col("db").bitwiseXOR(F.col("hb"))}).drop("ha", "hb")
        rows = materialise(rows, "prefixes")
        tables.keep(rows)
    return convs, rows


def prefix_sums(df: DataFrame, at: str, *values: str) -> DataFrame:
    """``df`` with the running sums of ``values`` over the dense places ``at`` (0, 1, ...), inclusive, as ``sum_<value>``."""
    names = [f"sum_{v}" for v in values]
    block = df.withColumn("_block", F.expr(f"{at} div {BLOCK}"))
    w = Window.partitionBy("_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    within = block.withColumns({s: F.sum(v).over(w) for v, s in zip(values, names, strict=True)})
    last = df.agg(F.max(at)).first()[0]
    if last is None or last < BLOCK:
        return within.drop("_block")
    # the totals of the blocks have places of their own; their sums before each block are added
    totals = materialise(block.groupBy(F.col("_block").alias("_at")).agg(*(F.sum(v).alias(v) for v in values)), "blocks")
    upto = prefix_sums(totals, "_at", *values).select((F.col("_at") + 1).alias("_block"), *(F.col(s).alias(f"_{s}") for s in names))
    added = {s: F.col(s) + F.coalesce(f"_{s}", F.lit(0)) for s in names}
    return within.join(upto, "_block", "left").withColumns(added).drop("_block", *(f"_{s}" for s in names))


def end_digests(ends: DataFrame) -> DataFrame:
    """(da, db, ends_sha256): SHA-256 of the ascending ids of ``ends(da, db, conv_id)``, comma-joined, per node.

    The ids are sorted by ranges, however many a node has, and packed to pieces there; the
    hash of a node then reads its pieces in order, one at a time.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"da": [node[0]], "db": [node[1]], "least": [ids[0]], "piece": [",".join(map(str, ids))]})

        for b in batches:
            for x, y, c in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if ids and (node != (x, y) or len(ids) >= PIECE):
                    yield out()
                    ids = []
                node = (x, y)
                ids.append(c)
        if ids:
            yield out()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashing = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"da": [node[0]], "db": [node[1]], "ends_sha256": [hashing.hexdigest()]})

        for b in batches:
            for x, y, _, piece in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if node != (x, y):
                    if node:
                        yield out()
                    node, hashing = (x, y), hashlib.sha256()
                else:
                    hashing.update(b",")
                hashing.update(piece.encode())
        if node:
            yield out()

    pieces = ends.repartitionByRange("da", "db", "conv_id").sortWithinPartitions("da", "db", "conv_id").mapInArrow(pack, "da long, db long, least long, piece string")
    return pieces.repartition("da", "db").sortWithinPartitions("da", "db", "least").mapInArrow(digest, "da long, db long, ends_sha256 string")


def _digest_text(a: Column, b: Column) -> Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def runs_in_preorder(rows: DataFrame, nodes: DataFrame, convs: DataFrame, root: int, total: int) -> DataFrame:
    """(conv_id, top, start, end): chains of nodes, by their smallest member and depth; places of the first node and of the last in its subtree."""
    heads = nodes.where((F.col("siblings") > 1) | (F.col("parent_conv_id") != F.col("conv_id"))).select("da", "db", F.col("conv_id").alias("owner"))
    on_path = rows.select("conv_id", "i", "da", "db").join(heads, ["da", "db"]).select("conv_id", "i", "owner", _digest_text(F.col("da"), F.col("db")).alias("digest"))
    at_root = convs.where(F.col("conv_id") == root).select("conv_id", F.lit(0).cast("long").alias("i"), F.col("conv_id").alias("owner"), F.lit("").alias("digest"))
    paths = on_path.union(at_root).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "owner", "digest"))).alias("heads"))
    # who owns a node owns all below it on its path, so the last head tells
    owning = paths.where(F.element_at("heads", -1)["owner"] == F.col("conv_id")).join(convs.select("conv_id", "len"), "conv_id")
    run = owning.select("conv_id", "len", "heads", F.posexplode("heads").alias("at", "head")).where("head.owner = conv_id")
    below = F.expr("coalesce(try_element_at(heads, at + 2).i, len + 1)")
    path = F.transform(F.slice("heads", 1, F.col("at") + 1), lambda h: h["digest"])
    runs = run.select("conv_id", F.col("head.i").alias("top"), (below - F.col("head.i")).alias("nodes"), path.alias("path"))
    runs = runs.withColumns({"own": F.element_at("path", -1), "path": F.filter("path", lambda p: p != "")})
    runs = _in_ranges(runs.withColumn("key", F.concat_ws("", "path")), "runs", F.col("key"))
    sizes = runs.select(F.explode("path").alias("own"), "nodes").groupBy("own").agg(F.sum("nodes").alias("size"))
    # a row a range: as few as there are partitions
    parts = runs.groupBy("part").agg(F.sum("nodes").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset")))
    w = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = runs.withColumn("upto", F.sum("nodes").over(w)).join(offsets, "part")
    start = F.col("offset") + F.col("upto") - F.col("nodes")
    size = F.when(F.col("own") == "", F.lit(total)).otherwise(F.col("size"))
    return placed.join(sizes, "own", "left").select("conv_id", "top", start.alias("start"), (start + size - 1).alias("end"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of rebuilt conversations, the textless root included: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; turns of one conversation go by turn (null first), ties
    by role and text. Rows without a conv_id belong to no conversation. Repeated rows are
    turns like others; a conversation that is rebuilt without turns is a member of the root.
    Texts are hashed and counted whole; other columns are not read. An empty table gives no rows.
    """
    convs, rows = rebuilt(conversations)
    first = convs.agg(F.min("conv_id"), F.count("*")).first()
    root, members = first
    spark = conversations.sparkSession
    names = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if root is None:
        return spark.createDataFrame([], names)

    found = rows.groupBy("da", "db").agg(F.min("conv_id").alias("conv_id"), F.min("i").alias("depth"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    top = [(0, 0, root, 0, members, 0, None, None)]
    found = found.union(spark.createDataFrame(top, "da long, db long, conv_id long, depth long, n_convs long, words long, pa long, pb long"))
    with scratch() as tables:
        found = materialise(found, "nodes")
        children = found.where("depth > 0").groupBy(F.col("pa").alias("da"), F.col("pb").alias("db")).agg(F.count("*").alias("n_children"))
        parents = children.join(found.select("da", "db", "conv_id"), ["da", "db"]).select(F.col("da").alias("pa"), F.col("db").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
        nodes = found.join(parents, ["pa", "pb"], "left").join(children, ["da", "db"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        nodes = materialise(nodes, "family")
        runs = runs_in_preorder(rows, nodes, convs, root, nodes.count())

        owned = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("top", "start", "end"))).alias("runs"))
        run = F.element_at(F.filter("runs", lambda r: r["top"] <= F.col("depth")), -1)
        placed = nodes.join(owned, "conv_id").withColumn("run", run)
        placed = placed.select("da", "db", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("run.start") + F.col("depth") - F.col("run.top")).alias("at"), F.col("run.end").alias("end"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
        summed = materialise(prefix_sums(materialise(placed, "places"), "at", "leaf", "saved"), "sums")
        tables.keep(summed)
    at_end = summed.select(F.col("at").alias("end"), F.col("sum_leaf").alias("end_leaf"), F.col("sum_saved").alias("end_saved"))

    last = rows.where("i = len").select("da", "db", "conv_id")
    turnless = convs.where("len = 0").select(F.lit(0).cast("long").alias("da"), F.lit(0).cast("long").alias("db"), "conv_id")
    digests = end_digests(last.union(turnless))
    out = summed.join(at_end, "end").join(digests, ["da", "db"], "left")
    inside = lambda v: F.col(f"end_{v}") - F.col(f"sum_{v}") + F.col(v)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", inside("leaf").alias("n_leaves"), inside("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
