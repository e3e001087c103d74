"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes its words (A-Z in lower case). Documents without any keyword of the rules go no
further. In the others every keyword's place is a hit: the words around it are held against
the rules of that keyword whose other needed words the document has. A match is a detection
with its words' places. A detection is suppressed where another of no lower priority contains it
(of equal priority and span the first rule stays), so that "gnu general public license version 3"
leaves no "gnu general public license" behind. Matches are at most ``REACH`` words long, so
only detections of hits within that distance can contain each other: work is linear in the text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import CONFIDENCE, REACH, Rule, rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of letters, digits and characters beyond ASCII, A-Z in lower case."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _BETWEEN, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or its lambdas use it."""
    return F.transform(F.array(value), body)[0]


_RULE = "struct<order:int,lead:int,needs:array<string>,pattern:string,label:string,priority:int,base:boolean>"


def _by_keyword(ruleset: list[Rule]) -> Column:
    """Map of each keyword to its rules, a constant that Spark folds."""
    by: dict[str, list[dict]] = {}
    for r in ruleset:
        by.setdefault(r.keyword, []).append(r._asdict() | {"pattern": f"^(?:{r.pattern})(?= |$)"})
    return F.from_json(F.lit(json.dumps(by)), f"map<string,array<{_RULE}>>")


def _detections(words: Column, found: Column, ruleset: list[Rule]) -> Column:
    """Array over the hits, in the order of their places, of arrays of detections."""
    keywords = F.array(*(F.lit(k) for k in sorted({r.keyword for r in ruleset})))
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(found, F.get(words, i)) & F.array_contains(keywords, F.get(words, i)))

    def match(i: Column, r: Column) -> Column:
        start = i - r["lead"]
        around = F.array_join(F.slice(words, F.greatest(start, F.lit(0)) + 1, F.lit(REACH)), " ")
        found_text = F.when(start >= 0, F.call_function("regexp_extract", around, r["pattern"], F.lit(0))).otherwise("")
        told = lambda x: F.struct((x != "").alias("hit"), start.alias("start"), (start + F.size(F.split(x, " "))).alias("end"), r["priority"].alias("priority"), r["order"].alias("order"), r["label"].alias("label"), r["base"].alias("base"))
        return _let(found_text, told)

    def of(i: Column, table: Column) -> Column:
        tried = F.filter(F.element_at(table, F.get(words, i)), lambda r: F.size(F.array_except(r["needs"], found)) == 0)
        return F.filter(F.transform(tried, lambda r: match(i, r)), lambda d: d["hit"])

    return _let(_by_keyword(ruleset), lambda table: F.transform(at, lambda i: of(i, table)))


def _contains(e: Column, d: Column) -> Column:
    """Whether detection e suppresses d."""
    longer = (e["start"] < d["start"]) | (e["end"] > d["end"])
    inside = (e["start"] <= d["start"]) & (e["end"] >= d["end"])
    return inside & ((e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & (longer | (e["order"] < d["order"]))))


def _unsuppressed(per_hit: Column) -> Column:
    # hits are at different places, so those within reach are at most REACH on either side
    near = lambda o: F.flatten(F.slice(per_hit, F.greatest(o - REACH, F.lit(0)) + 1, F.lit(2 * REACH + 1)))
    return F.flatten(F.transform(per_hit, lambda ds, o: F.filter(ds, lambda d: ~F.exists(near(o), lambda e: _contains(e, d)))))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def detections(text: Column, ruleset: list[Rule] | None = None) -> Column:
    """Struct of a text: n_words, ``base`` (all places of base phrases) and ``kept`` (detections that none suppresses).

    Each detection has start, end (words from 0, end exclusive), priority, order, label and base.
    """
    ruleset = ruleset or rules()
    vocabulary = F.array(*(F.lit(k) for k in sorted({w for r in ruleset for w in (r.keyword, *r.needs)})))
    none = F.array().cast("array<struct<hit:boolean,start:int,end:int,priority:int,order:int,label:string,base:boolean>>")

    def scanned(words: Column) -> Column:
        per_hit = _let(F.array_intersect(words, vocabulary), lambda found: _detections(words, found, ruleset))
        result = _let(per_hit, lambda ds: F.struct(F.filter(F.flatten(ds), lambda d: d["base"]).alias("base"), _unsuppressed(ds).alias("kept")))
        either = F.when(F.arrays_overlap(words, vocabulary), result).otherwise(F.struct(none.alias("base"), none.alias("kept")))
        return F.struct(F.size(words).cast("long").alias("n_words"), either.alias("found"))

    return _let(words_of(text), scanned)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ruleset: list[Rule] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    n_base counts all places of the base phrases, first_word and last_word are their smallest
    and largest start (null without any). base_labels and labels are distinct, sorted and comma-joined, the latter of the
    detections left and the base phrases. score is the confidence of the best detection left, 0 without any.
    ``detections`` has start, end (words, end exclusive) and label of each that is left, by hit.

    Null and empty texts have no words. Ids may be null or repeat; every row is scanned by itself, whole,
    whatever its length. Other columns are not read. An empty table comes back empty.
    """
    got = docs.select(F.col(id_col).alias("doc_id"), detections(F.col(text_col), ruleset).alias("d"))
    # a step of its own: what follows names the result several times
    got = got.select("doc_id", "d.n_words", F.col("d.found.base").alias("base"), F.col("d.found.kept").alias("kept"))
    label = lambda c: F.transform(c, lambda d: d["label"])
    start = lambda c: F.transform(c, lambda d: d["start"].cast("long"))
    sure = F.transform("kept", lambda d: F.element_at(F.array(*map(F.lit, CONFIDENCE)), d["priority"] + 1))
    return got.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(start(F.col("base"))).alias("first_word"),
        F.array_max(start(F.col("base"))).alias("last_word"),
        _joined(label(F.col("base"))).alias("base_labels"),
        _joined(F.concat(label(F.col("base")), label(F.col("kept")))).alias("labels"),
        F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
        F.transform("kept", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label"))).alias("detections"),
    )
