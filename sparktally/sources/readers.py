"""Readers of delimited, sparse and fixed-width rows under a declared schema, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_number


def _typed(raw: Column, f: T.StructField) -> Column:
    """A value of the declared kind: unknown categories, and ``?`` in a number that may not be missing, are errors."""
    raw = F.trim(raw)
    if "domain" in f.metadata:
        # names compare without case and come out as declared
        names = F.create_map(*(F.lit(x) for v in f.metadata["domain"] for x in (v.lower(), v)))
        hit = F.try_element_at(names, F.lower(raw))
        return F.when(hit.isNotNull(), hit).otherwise(F.raise_error(F.concat(F.lit(f"unknown value of {f.name}: "), F.coalesce(raw, F.lit("null")))))
    value = parse_number(raw)
    bad = value.isNull() if not f.metadata.get("missing") else value.isNull() & (raw != "?")
    return F.when(bad, F.raise_error(F.concat(F.lit(f"no number for {f.name}: "), F.coalesce(raw, F.lit("null")))).cast("double")).otherwise(value)


def parse_delimited(lines: DataFrame, schema: T.StructType, line: str = "value", sep: str = ",") -> DataFrame:
    """Rows of separated values in declared order; a wrong number of them is an error. Blank lines are left out."""
    parts = F.split(F.col(line), sep)
    k = len(schema.fields)
    checked = F.when(F.size(parts) == k, parts).otherwise(F.raise_error(F.concat(F.lit(f"expected {k} values: "), F.col(line))).cast("array<string>"))
    rows = lines.where(F.trim(line) != "").select(checked.alias("_p"))
    return rows.select(*(_typed(F.col("_p")[i], f).alias(f.name) for i, f in enumerate(schema.fields)))


def parse_sparse(lines: DataFrame, n: int, line: str = "value") -> DataFrame:
    """``<class> i:v j:v ...`` rows: the class and a_1 ... a_n, absent ones 0."""
    parts = F.split(F.trim(line), r"\s+")
    pairs = F.map_from_entries(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: F.struct(F.split(x, ":")[0].cast("int"), F.split(x, ":")[1].cast("double"))))
    rows = lines.where(F.trim(line) != "").select(parts[0].alias("class"), pairs.alias("_m"))
    return rows.select("class", *(F.coalesce(F.try_element_at("_m", F.lit(i)), F.lit(0.0)).alias(f"a_{i}") for i in range(1, n + 1)))


def parse_fixed_width(lines: DataFrame, schema: T.StructType, line: str = "value") -> DataFrame:
    """Rows cut by declared widths."""
    cols, at = [], 1
    for f in schema.fields:
        w = f.metadata["width"]
        cols.append(_typed(F.substring(F.col(line), at, w), f).alias(f.name))
        at += w
    return lines.select(*cols)


def read_pdata(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return parse_delimited(spark.read.text(path), schema)


def read_sparse(spark: SparkSession, path: str, n: int) -> DataFrame:
    return parse_sparse(spark.read.text(path), n)


def list_datasets(names: list[str]) -> list[tuple[str, str, str]]:
    """(name, declaration, data) of every pair among file names; orphans are left out."""
    have = set(names)
    return sorted((n[: -len(".pmeta")].rsplit("/", 1)[-1], n, n[: -len("meta")] + "data") for n in have if n.endswith(".pmeta") and n[: -len("meta")] + "data" in have)
