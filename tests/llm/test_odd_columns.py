"""Operators on tables whose columns carry the names that the operators use inside, and the odd entities of op6."""

import re

import pytest
from pyspark.sql import functions as F

from sparktally.llm import lines, mixing, surrogates

NAMES = ["weight", "target", "p", "q", "bin", "last", "scale", "n_lines", "n_dropped", "kinds", "n_entities", "row", "list", "id", "th", "gid", "cell", "copy", "copies"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three\nfour", "s"), (2, "One two three\nfive", "s"), (None, "one two three", None), (3, None, "t"), (4, "", "t"), (4, "mail a.b@c.org", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({n: F.lit(9.5) for n in NAMES})


def test_mixed_documents(docs, spark):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and {tuple(r[3:]) for r in got.collect()} == {(9.5,) * len(NAMES)}
    other = docs.withColumnsRenamed({"id": "id2", "doc_id": "id"})
    assert mixing.mixed_documents(other, id_col="id").columns == other.columns
    # documents of weight 0 are never taken
    heavy = docs.withColumn("w", F.when(F.col("doc_id") == 1, 1.0).otherwise(0.0))
    assert {r.doc_id for r in mixing.mixed_documents(heavy, weight_col="w").collect()} <= {1}
    assert mixing.mixed_documents(docs.where("false")).count() == 0


def test_lines_and_surrogates(docs):
    got = lines.dedup_lines(docs, counts=False)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, "one two three\nfour"), (2, "five"), (None, ""), (3, None), (4, ""), (4, "mail a.b@c.org")}
    full = lines.dedup_lines(docs)
    assert sorted(full.columns) == sorted(docs.columns) and {r.n_dropped for r in full.collect()} == {0, 1}
    said = surrogates.with_surrogates(docs, "k")
    assert sorted(said.columns) == sorted(docs.columns)
    assert sum(r.n_entities for r in said.collect()) == 1


def test_small_forms_never_run_out(spark):
    mails = [f"{a}@{b}.co" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    df = spark.createDataFrame(list(enumerate(mails)) + [(1000, "_@-.com")], "doc_id long, text string")
    new = {r.doc_id: r.text for r in surrogates.with_surrogates(df, "k").collect()}
    assert len(set(new.values())) == 401 and not set(new.values()) & {*mails, "_@-.com"}


def test_long_domains_and_coreference(spark):
    rows = [(1, "x@" + "a." * 20_000 + "com end"), (2, "Mrs. Anna Smith met Dr. Anna Smith. Anna Smith left, Smith said; Smithson did not."), (3, "call +1 743-555-3824 or +44 743-555-3824 or 743-555-3824")]
    got = {r.doc_id: r.text for r in surrogates.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert got[1].endswith(".com end") and len(got[1]) == len(rows[0][1]) and "x@a.a.a." not in got[1]
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Dr\. (\w+) (\w+)\. (\w+) (\w+) left, (\w+) said; Smithson did not\.", got[2])
    given, family = m[1], m[2]
    assert m.groups() == (given, family, given, family, given, family, family) and given.endswith("na") and "Smith" not in (given, family)
    a, b, c = re.fullmatch(r"call \+1 (\S+) or \+44 (\S+) or (\S+)", got[3]).groups()
    assert a == c != b
