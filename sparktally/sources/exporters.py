"""Rows as lines of text for other tools; each returns a one-column DataFrame ready for ``write.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _num(c: Column) -> Column:
    """Four decimals; ``?`` for null."""
    return F.when(c.isNull(), "?").otherwise(F.format_string("%.4f", c))


def arff_header(name: str, cats: dict[str, list[str]], nums: list[str], y: str, classes: list[str]) -> list[str]:
    head = [f"@relation {name}"]
    head += [f"@attribute {c} {{{','.join(v)}}}" for c, v in cats.items()]
    head += [f"@attribute {c} numeric" for c in nums]
    return [*head, f"@attribute {y} {{{','.join(classes)}}}", "@data"]


def arff_rows(df: DataFrame, cats: list[str], nums: list[str], y: str = "y") -> DataFrame:
    return df.select(F.concat_ws(",", *(F.coalesce(F.col(c), F.lit("?")) for c in cats), *(_num(F.col(c)) for c in nums), F.col(y)).alias("value"))


def vw_rows(df: DataFrame, cats: list[str], nums: list[str], classes: list[str], y: str = "y") -> DataFrame:
    """Labels count from 1; categories as name=value features, numbers as name:value, unknown ones left out."""
    label = F.array_position(F.array(*map(F.lit, classes)), F.col(y)).cast("string")
    feats = [F.concat(F.lit(f"{c}="), F.col(c)) for c in cats] + [F.concat(F.lit(f"{c}:"), F.format_string("%.4f", F.col(c))) for c in nums]
    return df.select(F.concat(label, F.lit(" | "), F.concat_ws(" ", *(F.when(F.col(c).isNotNull(), x) for c, x in zip(cats + nums, feats, strict=True)))).alias("value"))


def svm_rows(df: DataFrame, cats: dict[str, list[str]], nums: list[str], classes: list[str], y: str = "y") -> DataFrame:
    """Sparse one-hot rows, indices from 1; two classes are -1 and +1; zeros and unknowns left out."""
    label = F.when(F.col(y) == classes[-1], "+1").otherwise("-1") if len(classes) == 2 else F.array_position(F.array(*map(F.lit, classes)), F.col(y)).cast("string")
    parts, at = [], 1
    for c, values in cats.items():
        place = F.array_position(F.array(*map(F.lit, values)), F.col(c))
        parts.append(F.when(place > 0, F.concat((place + (at - 1)).cast("string"), F.lit(":1"))))
        at += len(values)
    for c in nums:
        parts.append(F.when(F.col(c).isNotNull() & (F.col(c) != 0), F.concat(F.lit(f"{at}:"), F.format_string("%.4f", F.col(c)))))
        at += 1
    return df.select(F.concat_ws(" ", label, *parts).alias("value"))


def code_rows(df: DataFrame, cats: dict[str, list[str]], nums: list[str], classes: list[str], y: str = "y", sep: str = ",") -> DataFrame:
    """Categories and class as codes from 0 in declared order, numbers as they are."""
    code = lambda c, vs: (F.array_position(F.array(*map(F.lit, vs)), F.col(c)) - 1).cast("string")
    return df.select(F.concat_ws(sep, *(code(c, v) for c, v in cats.items()), *(_num(F.col(c)) for c in nums), code(y, classes)).alias("value"))


def result_document(metrics: DataFrame) -> DataFrame:
    """One JSON document per run: its metrics as an array, NaN and infinity as null."""
    clean = F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value"))
    row = F.struct("learner", "metric", "trial", "fold", clean.alias("value"))
    return metrics.groupBy("run_id").agg(F.to_json(F.struct(F.lit(1).alias("schema"), F.array_sort(F.collect_list(row)).alias("metrics"))).alias("doc"))


RESULT_DDL = "schema int, dataset string, mode string, learners array<string>, metrics array<struct<learner:string,metric:string,trial:int,fold:int,value:double>>, confusion array<struct<learner:string,noClasses:int,matrix:array<int>>>"


def ingest(docs: DataFrame, doc: str = "doc", run: str = "run_id") -> dict[str, DataFrame]:
    """Result documents as tidy tables; a null fold is the pooled one (-1), a null trial the first (0)."""
    d = docs.select(run, F.from_json(doc, RESULT_DDL).alias("d"))
    m = d.select(run, F.explode("d.metrics").alias("m")).select(run, "m.learner", "m.metric", F.coalesce("m.trial", F.lit(0)).alias("trial"), F.coalesce("m.fold", F.lit(-1)).alias("fold"), "m.value")
    c = d.select(run, F.explode("d.confusion").alias("c")).select(run, "c.learner", "c.noClasses", F.posexplode("c.matrix").alias("i", "n"))
    c = c.select(run, "learner", (F.col("i") / F.col("noClasses")).cast("int").alias("t"), (F.col("i") % F.col("noClasses")).alias("p"), "n")
    return {"metrics": m, "confusion": c, "runs": d.select(run, "d.dataset", "d.mode", "d.learners")}
