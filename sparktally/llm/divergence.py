"""How far the sources of a language lie apart: joint count histograms of pairs of sources.

Every input task counts the terms of its rows by language and source and combines what it
has seen before anything is shuffled. A second, much smaller shuffle brings the counts of
one term together: a row per kept term with its count in each source that has it.

Two sources are compared by their joint histogram, how many terms have which pair of
counts. Terms that both sources hold are tallied from the terms' rows; the zero cells are
implied: (c, 0) is the first source's own histogram at c less what the joint one holds of
c, and (0, 0) is what is left of the vocabulary. The divergence is then evaluated once per
cell and weighed by the cell's count, so it costs as much as there are distinct pairs of
counts, not terms. All arithmetic is on integers (decimals where a product may pass 64 bits).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch, small_side

MIN_DOCS = 10
TOP_TERMS = 10
#: Terms that a task holds before it hands its counts on.
HELD_TERMS = 400_000

_UPPER, _LOWER = range(0x41, 0x5B), range(0x61, 0x7B)
#: Letters in lower case, bytes of other scripts as they are, all else a space.
_LETTERS = bytes(b + 32 if b in _UPPER else b if b in _LOWER or b > 0x7F else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z in lower case, as UTF-8."""
    return (text or "").encode().translate(_LETTERS).split()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and documents that have it.

    A group without terms has one row, its term null and its counts zero.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in seen.items():
                rows = [(None, 0, 0)] if not n else [(t.decode(), c, d[t]) for t, c in n.items()]
                cols = list(zip(*rows, strict=True))
                same = [pa.array([x] * len(rows), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, d = seen.setdefault((lang, source), (Counter(), Counter()))
                words, before = terms(text), len(n)
                n.update(words)
                d.update(set(words))
                held += len(n) - before
                if held > HELD_TERMS:
                    yield from out()
                    seen, held = {}, 0
        yield from out()

    given = docs.select(F.col(text_col).cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col)))
    parts = given.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), exactly."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", top, F.nullif(n + 2 * v, F.lit(0)).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so the square is within 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def joint_histograms(vectors: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, n): n > 0 kept terms of the language have counts ca in source a and cb in source b, for a < b.

    ``vectors(lang, v)`` has a row per kept term, v its (source, n) by source; ``groups(lang,
    source)`` all groups; ``sizes(lang, v)`` the number of kept terms.
    """
    first = vectors.select("lang", "v", F.posexplode("v").alias("at", "x"))
    pair = first.select("lang", "x", F.explode(F.slice("v", F.col("at") + 2, F.size("v"))).alias("y"))
    both = pair.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("ca"), F.col("y.n").alias("cb")).agg(F.count("*").alias("n"))
    cell = lambda ca, cb, n: F.struct(ca.cast("long").alias("ca"), cb.cast("long").alias("cb"), n.cast("long").alias("n"))
    zero, n = F.lit(0), F.col("n")
    # a joint cell stands for itself and is taken off the zero cells it was counted in below
    shared = both.select("lang", "a", "b", F.explode(F.array(cell(F.col("ca"), F.col("cb"), n), cell(F.col("ca"), zero, -n), cell(zero, F.col("cb"), -n), cell(zero, zero, n))).alias("c"))
    own = vectors.select("lang", F.explode("v").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("c")).agg(F.count("*").alias("n"))
    left, right = groups.select("lang", F.col("source").alias("a")), groups.select("lang", F.col("source").alias("b"))
    pairs = left.join(right, "lang").where("a < b")
    alone_a = own.withColumnRenamed("source", "a").join(small_side(pairs), ["lang", "a"]).select("lang", "a", "b", F.explode(F.array(cell(F.col("c"), zero, n), cell(zero, zero, -n))).alias("c"))
    alone_b = own.withColumnRenamed("source", "b").join(small_side(pairs), ["lang", "b"]).select("lang", "a", "b", F.explode(F.array(cell(zero, F.col("c"), n), cell(zero, zero, -n))).alias("c"))
    rest = pairs.join(sizes, "lang").select("lang", "a", "b", cell(zero, zero, F.col("v")).alias("c"))
    cells = shared.union(alone_a).union(alone_b).union(rest).select("lang", "a", "b", "c.*")
    return cells.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("n").alias("n")).where("n > 0")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank of every group: its distance from each other source of the
    language (part ``pair``, all ranks) and the terms it has more often than the language (part ``term``, ranks to 10).

    Null languages and sources are the empty string, groups like others; null and empty texts
    have no terms but make their group. Repeated rows are documents of their own. Equal values
    rank by item. A language in which no term is kept has distances of 0; a group that is alone in its
    language has no pairs. An empty table gives no rows. Texts are read whole, whatever their length.
    """
    with scratch() as tables:
        counts = materialise(term_counts(docs, text_col, lang_col, source_col), "term-counts")
        groups = materialise(counts.select("lang", "source").distinct(), "groups")
        by_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("v"))
        kept = materialise(by_term.where(F.col("docs") >= min_docs).select("lang", "term", "v"), "kept-terms")
        tables.keep(groups, kept)
    # languages are few; each has its vocabulary and the words of all its groups
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["n"])).alias("all"))
    langs = groups.select("lang").distinct().join(of_lang, "lang", "left").select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("all", F.lit(0)).alias("all"))
    own = kept.select("lang", F.explode("v").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("words"))
    known = groups.join(own, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", F.coalesce("words", F.lit(0)).alias("words"), "kept", "all")
    known = small_side(materialise(known, "group-sizes"))

    cells = joint_histograms(kept.select("lang", "v"), groups, langs.select("lang", F.col("kept").alias("v")))
    a = known.select("lang", F.col("source").alias("a"), F.col("words").alias("na"), "kept")
    b = known.select("lang", F.col("source").alias("b"), F.col("words").alias("nb"))
    f = apart(scaled(F.col("ca"), F.col("na"), F.col("kept")), scaled(F.col("cb"), F.col("nb"), F.col("kept")))
    values = cells.join(a, ["lang", "a"]).join(b, ["lang", "b"]).groupBy("lang", "a", "b").agg(F.sum(F.col("n") * f).alias("value"))
    every = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b").join(values, ["lang", "a", "b"], "left")
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = every.select("lang", ways.alias("w"), F.coalesce("value", F.lit(0)).alias("value")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    in_all = kept.select("lang", "term", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_lang"), F.explode("v").alias("x"))
    of = in_all.select("lang", "x.source", "term", "x.n", "n_lang").join(known, ["lang", "source"])
    pq = of.withColumns({"p": scaled(F.col("n"), F.col("words"), F.col("kept")), "q": scaled(F.col("n_lang"), F.col("all"), F.col("kept"))}).where("p > q")
    term = pq.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pair.withColumn("rank", F.row_number().over(w)).union(term.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_terms))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
