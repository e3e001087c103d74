"""Multinomial logistic regression on categorical attributes by L-BFGS over count cells.

The score of a class is its own weight plus one for each attribute's value, each times a
scale: 1, or with ``scaled`` the log of the naive Bayes parameter that the weight belongs to, so
that weights of 1 are naive Bayes and training discriminatively mends it. Cells are coded once;
an evaluation of loss and gradient is one job, in which every task sums its own cells and
Spark adds the sums up by parameter. The driver holds vectors of one number per parameter:
classes times attribute values, never rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bayes import softmax
from .counts import cube, labels
from .session import shared_dir


@dataclass
class Logistic:
    """weights[c] and scale[c]: the class itself, then the values of each attribute in the order of ``domains``."""

    atts: list[str]
    classes: list[str]
    domains: list[list[str]]
    weights: np.ndarray
    scale: np.ndarray

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``p``: the posterior per class. Null and unknown values add nothing."""
        product, at = self.weights * self.scale, 1
        logs: Column = F.array(*(F.lit(float(x)) for x in product[:, 0]))
        zeros = F.array(*(F.lit(0.0) for _ in self.classes))
        for a, domain in zip(self.atts, self.domains, strict=True):
            table = {v: [float(x) for x in product[:, at + i]] for i, v in enumerate(domain)}
            each = F.coalesce(F.try_element_at(_constant(table, "array<double>"), F.col(a).cast("string")), zeros)
            logs = F.zip_with(logs, each, lambda x, y: x + y)
            at += len(domain)
        return rows.withColumn("_lp", logs).withColumn("p", softmax(F.col("_lp"))).drop("_lp")


def _constant(table: dict, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>")


def code_cells(cells: DataFrame, atts: list[str], classes: list[str], domains: list[list[str]]) -> DataFrame:
    """(at, n, codes): class index, weight and for each attribute the column of its weights, -1 where its value is null."""
    codes, start = [], 1
    for a, domain in zip(atts, domains, strict=True):
        table = {v: start + i for i, v in enumerate(domain)}
        codes.append(F.coalesce(F.try_element_at(_constant(table, "int"), F.col(a).cast("string")), F.lit(-1)))
        start += len(domain)
    at = (F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1).cast("int")
    return cells.select(at.alias("at"), F.col("n").cast("double").alias("n"), F.array(*codes).alias("codes"))


def loss_and_gradient(coded: DataFrame, weights: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative conditional log likelihood and its gradient: one job, summed by parameter."""
    nc, width = weights.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a column of zeros at the end takes the codes of unknown values
        product = np.hstack([weights * scale, np.zeros((nc, 1))])
        loss, grad, any_rows = 0.0, np.zeros((nc, width + 1)), False
        for b in batches:
            if not b.num_rows:
                continue
            any_rows = True
            at, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            codes = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            logs = product[:, :1].T + product[:, codes].sum(2).T
            logs -= logs.max(1, keepdims=True)
            logs -= np.log(np.exp(logs).sum(1, keepdims=True))
            loss -= float((n * logs[np.arange(len(at)), at]).sum())
            miss = np.exp(logs)
            miss[np.arange(len(at)), at] -= 1.0
            miss *= n[:, None]
            grad[:, 0] += miss.sum(0)
            for col in range(codes.shape[1]):
                for c in range(nc):
                    grad[c] += np.bincount(codes[:, col] % (width + 1), weights=miss[:, c], minlength=width + 1)
        if any_rows:
            flat = (grad[:, :width] * scale).ravel()
            used = np.flatnonzero(flat)
            yield pa.RecordBatch.from_pydict({"at": pa.array([-1, *used], pa.int64()), "value": pa.array([loss, *flat[used]], pa.float64())})

    loss, out = 0.0, np.zeros(nc * width)
    for r in coded.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        if r["at"] < 0:
            loss = r["value"]
        else:
            out[r["at"]] = r["value"]
    return loss, out.reshape(nc, width)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, memory: int = 6, epsilon: float = 1e-5, iterations: int = 100) -> tuple[np.ndarray, float, int]:
    """(x, f(x), evaluations): limited-memory BFGS with the two-loop recursion and a weak Wolfe line search by bisection.

    Ends when the gradient's norm is at most ``epsilon`` times the larger of 1 and the norm of x, or no step helps.
    """
    fx, g = f(x)
    seen, past = 1, []
    for _ in range(iterations):
        if np.linalg.norm(g) <= epsilon * max(1.0, np.linalg.norm(x)):
            break
        d, alphas = -g, []
        for s, y in reversed(past):
            alphas.append(np.vdot(s, d) / np.vdot(s, y))
            d = d - alphas[-1] * y
        if past:
            s, y = past[-1]
            d = d * (np.vdot(s, y) / np.vdot(y, y))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d = d + s * (a - np.vdot(y, d) / np.vdot(s, y))
        slope = float(np.vdot(g, d))
        low, high, step = 0.0, np.inf, 1.0 if past else 1.0 / float(np.linalg.norm(g))
        for _ in range(40):
            new = x + step * d
            f_new, g_new = f(new)
            seen += 1
            if not f_new <= fx + 1e-4 * step * slope:
                high = step
            elif np.vdot(g_new, d) < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if np.isfinite(high) else 2 * low
        else:
            break
        if np.vdot(g_new - g, new - x) > 1e-12:
            past = [*past, (new - x, g_new - g)][-memory:]
        x, fx, g = new, f_new, g_new
    return x, fx, seen


def domains_of(cells: DataFrame, atts: list[str]) -> list[list[str]]:
    """Values of each attribute in order: metadata, as long as all domains together."""
    entries = F.array(*(F.struct(F.lit(i).alias("i"), F.col(a).cast("string").alias("v")) for i, a in enumerate(atts)))
    found = cells.select(F.explode(entries).alias("e")).select("e.*").where("v is not null").distinct().collect()
    return [sorted(r["v"] for r in found if r["i"] == i) for i in range(len(atts))]


def naive_bayes_scale(cells: DataFrame, atts: list[str], classes: list[str], domains: list[list[str]], m: float = 1.0) -> np.ndarray:
    """Logs of P(y) and P(value | y) by m-estimates, laid out as the weights are."""
    out = [np.zeros((len(classes), 1)), *(np.zeros((len(classes), len(d))) for d in domains)]
    for r in cells.groupBy("y").agg(F.sum("n").alias("n")).collect():
        out[0][classes.index(r["y"]), 0] = r["n"]
    for r in cube(cells, atts, 1).collect():
        if r["v1"] is not None:
            a = atts.index(r["a1"])
            out[1 + a][classes.index(r["y"]), domains[a].index(str(r["v1"]))] = r["n"]
    ny = out[0]
    prior = np.log((ny + m / len(classes)) / (ny.sum() + m))
    return np.hstack([prior, *(np.log((t + m / t.shape[1]) / (ny + m)) for t in out[1:])])


def fit_logistic(cells: DataFrame, atts: list[str], scaled: bool = False, start: float | None = None, m: float = 1.0, epsilon: float = 1e-5, iterations: int = 100) -> Logistic:
    """Weights of least conditional log loss on the cells. ``start`` is each weight's first value: 0, or 1 (naive Bayes) where scaled."""
    classes, domains = labels(cells), domains_of(cells, atts)
    width = 1 + sum(map(len, domains))
    scale = naive_bayes_scale(cells, atts, classes, domains, m) if scaled else np.ones((len(classes), width))
    shared_dir(cells.sparkSession)
    coded = code_cells(cells, atts, classes, domains).checkpoint()
    first = np.full((len(classes), width), float(scaled) if start is None else start)
    weights, _, _ = minimise(lambda w: loss_and_gradient(coded, w, scale), first, epsilon=epsilon, iterations=iterations)
    return Logistic(atts, classes, domains, weights, scale)
