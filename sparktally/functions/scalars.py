"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_text(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    return a == b if case_sensitive else F.lower(a) == F.lower(b)


def trimmed(c: Column) -> Column:
    """Without trailing spaces."""
    return F.rtrim(c)


def underscored(c: Column) -> Column:
    return F.regexp_replace(c, "[ -]", "_")


def four_places(c: Column) -> Column:
    return F.format_string("%.4f", c)


def parse_number(c: Column) -> Column:
    """Sign, decimals and exponent; null for ``?`` and for what is no number."""
    return F.when(F.trim(c) == "?", None).otherwise(F.trim(c).try_cast("double"))


def precision(c: Column) -> Column:
    """Digits after the point."""
    return F.length(F.regexp_extract(c, r"\.([0-9]*)", 1))


def parse_ints(c: Column) -> Column:
    """A comma list of whole numbers as an array."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x).cast("int"))


def normalised(a: Column) -> Column:
    """An array divided by its sum; null where that is 0."""
    total = F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return F.when(total != 0, F.transform(a, lambda x: x / total))


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(F.aggregate(a, F.lit(0.0), lambda x, y: x + F.exp(y - top)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gauss_pdf(x: Column, mean: Column, sd: Column) -> Column:
    return F.exp(-F.pow((x - mean) / sd, 2) / 2) / (sd * F.sqrt(F.lit(6.283185307179586)))


def empirical_m_estimate(n: Column, total: Column, prior: Column, m: float = 1.0) -> Column:
    """Smoothing towards a prior instead of 1 / k."""
    return (n + prior * m) / (total + m)


def unflatten(matrix: Column, k: Column) -> Column:
    """array<struct<t, p, n>> of a row-major k by k matrix."""
    return F.transform(matrix, lambda n, i: F.struct((i / k).cast("int").alias("t"), (i % k).cast("int").alias("p"), n.alias("n")))


def get_or_zero(a: Column, i: Column | int) -> Column:
    return F.coalesce(F.get(a, i), F.lit(0.0))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def progress_fold(line: Column) -> Column:
    """The fold number in a log line; null where there is none."""
    return F.regexp_extract(line, r"[Ff]old\s*[:=]?\s*(\d+)", 1).try_cast("int")


def to_shanghai(ts: Column) -> Column:
    """A UTC time as ISO text with +08:00."""
    return F.concat(F.date_format(F.from_utc_timestamp(ts, "+08:00"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))


#: Job states and where each may go.
TRANSITIONS = {"pending": {"running", "cancelled"}, "running": {"done", "failed", "cancelled"}, "done": set(), "failed": set(), "cancelled": set()}


def next_state(state: str, wanted: str) -> str:
    if wanted not in TRANSITIONS.get(state, set()):
        raise ValueError(f"{state} cannot become {wanted}")
    return wanted


PLAN_WORDS = {"metric": {"auc": "auc", "rmse": "rmse", "mcc": "mcc", "log": "log_loss", "error": "0-1_loss"}, "mode": {"curve": "curves", "stream": "stream", "cross": "xval", "fold": "xval"}}


def plan_from_text(text: str, datasets: list[str], learners: list[str]) -> dict:
    """Key words of a request as a job: known data sets and learners, metric, mode, folds from 2 to 20."""
    import re

    low = text.lower()
    words = set(re.findall(r"[\w-]+", low))
    pick = lambda kind, default: next((v for k, v in PLAN_WORDS[kind].items() if k in low), default)
    folds = re.search(r"(\d+)[- ]?fold", low)
    return {
        "datasets": [x for x in datasets if x.lower() in words],
        "learners": [x for x in learners if x.lower() in words] or ["nb"],
        "metric": pick("metric", "0-1_loss"),
        "mode": pick("mode", "xval"),
        "folds": min(20, max(2, int(folds[1]))) if folds else 10,
    }
