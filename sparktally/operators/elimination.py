"""Backward elimination of AODE's parents and children by leave-one-out error, one job a round.

The cells get the counts of every attribute and pair once. A round then takes each batch of
cells as one block: the log factors of all parents and children are summed for the model as
it stands, and a removal is scored by taking its factors out again, so all removals of a
round cost little more than the model itself. What leaves a task is one error per removal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bayes import AnDE, Lookup
from .counts import domain_sizes, labels
from .session import shared_dir

#: What a round may remove: a child, a parent, or an attribute as both; the last mode takes the best of all three.
MODES = {"ce": ("child",), "pe": ("parent",), "pace": ("both",), "poce": ("child", "parent", "both")}


def leave_one_out_cells(cells: DataFrame, atts: list[str], classes: list[str]) -> DataFrame:
    """(at, n, ny, counts): class index, weight and the counts per class of all rows, of each attribute and of each pair."""
    lookup = Lookup(cells, classes)
    subsets = [[a] for a in atts] + [list(p) for p in combinations(atts, 2)]
    rows = lookup.add_all(lookup.add(cells, [], "ny"), subsets, atts, "counts")
    return rows.select((F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1).cast("int").alias("at"), F.col("n").cast("double").alias("n"), "ny", "counts")


def log_factors(ny: np.ndarray, counts: np.ndarray, sizes: list[int], m: float) -> tuple[np.ndarray, np.ndarray]:
    """(factors, seen) of a block of rows, by the counts per class of all rows, of each attribute's value and of each pair's.

    factors[b, p, c] has the logs per class of P(c | p, y), on the diagonal of P(p, y);
    seen[b, p] tells whether any row has the parent's value.
    """
    b, a, nc = len(ny), len(sizes), ny.shape[1]
    out = np.empty((b, a, a, nc))
    for i in range(a):
        out[:, i, i] = np.log((counts[:, i] + m / (nc * sizes[i])) / (ny.sum(1)[:, None] + m))
    for k, (i, j) in enumerate(combinations(range(a), 2), a):
        out[:, i, j] = np.log((counts[:, k] + m / sizes[j]) / (counts[:, i] + m))
        out[:, j, i] = np.log((counts[:, k] + m / sizes[i]) / (counts[:, j] + m))
    return out, counts[:, :a].sum(2) > 0


def without_own(ny: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a block of rows less the row itself, of class ``at``."""
    own = np.zeros_like(ny)
    own[np.arange(len(at)), at] = 1.0
    return ny - own, np.maximum(counts - own[:, None, :], 0.0)


def removal_errors(factors: np.ndarray, seen: np.ndarray, at: np.ndarray, n: np.ndarray, parents: list[int], children: list[int], kinds: tuple[str, ...]) -> dict[tuple[str, int], float]:
    """Weighted squared error of the model ("", -1) and of each removal; a cell without a seen parent is held uniform."""
    everyone = np.arange(len(at))
    sums = {p: factors[:, p, p] + sum((factors[:, p, c] for c in children if c != p), np.zeros_like(factors[:, p, p])) for p in parents}

    def error(logs: dict[int, np.ndarray]) -> float:
        stack = np.stack([np.where(seen[:, p, None], x, -np.inf) for p, x in logs.items()], 1)
        top = stack.max((1, 2), keepdims=True)
        votes = np.exp(stack - np.where(np.isfinite(top), top, 0.0)).sum(1)
        whole = votes.sum(1)
        share = np.where(whole > 0, votes[everyone, at] / np.where(whole > 0, whole, 1.0), 1.0 / votes.shape[1])
        return float((n * (1.0 - share) ** 2).sum())

    without = lambda a: {p: x - factors[:, p, a] if p != a else x for p, x in sums.items()}
    out = {("", -1): error(sums)}
    for kind in kinds:
        able = {"child": children, "parent": parents, "both": [a for a in parents if a in children]}[kind]
        if (kind != "child" and len(parents) == 1) or (kind != "parent" and len(children) == 1):
            continue
        for a in able:
            left = sums if kind == "parent" else without(a)
            out[kind, a] = error(left if kind == "child" else {p: x for p, x in left.items() if p != a})
    return out


def round_errors(rows: DataFrame, sizes: list[int], classes: int, parents: list[int], children: list[int], kinds: tuple[str, ...], m: float) -> DataFrame:
    """(kind, att, n, rmse): leave-one-out error of the model (kind "") and of each removal; ``rows`` from leave_one_out_cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            ny = b.column(2).flatten().to_numpy().reshape(-1, classes)
            counts = b.column(3).flatten().flatten().to_numpy().reshape(len(at), -1, classes)
            factors, seen = log_factors(*without_own(ny, counts, at), sizes, m)
            found = removal_errors(factors, seen, at, n, parents, children, kinds)
            yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in found], "att": pa.array([a for _, a in found], pa.int32()), "n": [float(n.sum())] * len(found), "sse": list(found.values())})

    parts = rows.mapInArrow(run, "kind string, att int, n double, sse double")
    return parts.groupBy("kind", "att").agg(F.sum("n").alias("n"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))


def eliminate(cells: DataFrame, atts: list[str], mode: str = "poce", m: float = 1.0) -> tuple[AnDE, list[tuple[int, str, str, float]]]:
    """The AODE that is left when no removal of ``mode`` lowers the leave-one-out RMSE, and the steps: (round, kind, attribute, rmse).

    Each round removes what leaves the least error; of equals a child before a parent before
    both, then the earlier attribute. The last parent and the last child stay. What
    reaches the driver is one number per removal.
    """
    classes, sizes = labels(cells), domain_sizes(cells, atts)
    shared_dir(cells.sparkSession)
    rows = leave_one_out_cells(cells, atts, classes).checkpoint()
    kinds, parents, children, steps = MODES[mode], list(range(len(atts))), list(range(len(atts))), []
    while True:
        found = round_errors(rows, [sizes[a] for a in atts], len(classes), parents, children, kinds, m).collect()
        error = {(r["kind"], r["att"]): round(r["rmse"], 9) for r in found}
        now = error.pop(("", -1))
        if not steps:
            steps.append((0, "", "", now))
        best = min(error, key=lambda k: (error[k], kinds.index(k[0]), k[1]), default=None)
        if best is None or error[best] >= now:
            return AnDE(atts, 1, m, selected=[atts[p] for p in parents], children=[atts[c] for c in children]), steps
        kind, a = best
        steps.append((len(steps), kind, atts[a], error[best]))
        if kind != "child":
            parents.remove(a)
        if kind != "parent":
            children.remove(a)
