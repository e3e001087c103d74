"""Streams without timestamps: rows have a place in arrival order and operators keep bounded state per key.

The same step functions serve a stream (``transformWithStateInPandas``) and, for tests and
finished streams, a batch in order.
"""

from __future__ import annotations

import json
import math
import uuid
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator, MutableMapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.bayes import AnDE
from ..operators.counts import cuboid, domain_sizes, labels
from ..operators.evaluate import prequential_members
from ..operators.sampling import ranges
from ..operators.session import shared_dir


#: Rows of a stretch of a stream that one task goes through in order.
STRETCH_ROWS = 500_000


class SlidingBins:
    """Equal-frequency bins against the last ``window`` values of one attribute; each value is binned before it is added."""

    def __init__(self, bins: int = 5, window: int = 1000) -> None:
        self.bins, self.window = bins, window
        self.order: list[float] = []
        self.held: list[float] = []

    def step(self, v: float | None) -> int | None:
        if v is None or v != v:
            return None
        code = min(self.bins - 1, bisect_left(self.held, v) * self.bins // len(self.held)) if self.held else 0
        insort(self.held, v)
        self.order.append(v)
        if len(self.order) > self.window:
            del self.held[bisect_left(self.held, self.order.pop(0))]
        return code

    def dump(self) -> str:
        return json.dumps(self.order)

    def load(self, said: str) -> None:
        self.order = json.loads(said)
        self.held = sorted(self.order)


class SampledBins(SlidingBins):
    """Bins against a uniform sample of all values so far: after the sample is full, value n replaces one with chance size / n."""

    seen = 0

    def step(self, v: float | None) -> int | None:
        if v is None or v != v:
            return None
        code = min(self.bins - 1, bisect_left(self.held, v) * self.bins // len(self.held)) if self.held else 0
        self.seen += 1
        if len(self.order) < self.window:
            insort(self.held, v)
            self.order.append(v)
        else:
            # a repeatable draw, so that a replayed batch leaves the same state
            at = (self.seen * 2654435761) % (1 << 32) * self.seen >> 32
            if at < self.window:
                del self.held[bisect_left(self.held, self.order[at])]
                insort(self.held, v)
                self.order[at] = v
        return code

    def dump(self) -> str:
        return json.dumps([self.seen, self.order])

    def load(self, said: str) -> None:
        self.seen, self.order = json.loads(said)
        self.held = sorted(self.order)


class PartitionIncremental:
    """Two-layer bins: fine counted cells over a known range, split when one holds too much; cuts follow the counts."""

    def __init__(self, low: float, high: float, bins: int = 5, multiplier: int = 20) -> None:
        self.bins = bins
        cells = bins * multiplier
        step = (high - low) / cells or 1.0
        self.edges = [low + step * i for i in range(1, cells)]
        self.counts = [0.0] * cells
        self.seen = 0

    def step(self, v: float | None) -> int | None:
        if v is None or v != v:
            return None
        at = bisect_left(self.edges, v)
        code = int(self.bins * (sum(self.counts[:at]) + self.counts[at] / 2) / self.seen) if self.seen else 0
        self.counts[at] += 1
        self.seen += 1
        if self.counts[at] > 2 * self.seen / len(self.counts) and self.seen > len(self.counts) and 0 < at < len(self.edges):
            mid = (self.edges[at - 1] + self.edges[at]) / 2
            if self.edges[at - 1] < mid < self.edges[at]:
                half = self.counts[at] / 2
                self.edges.insert(at, mid)
                self.counts[at : at + 1] = [half, half]
        return min(code, self.bins - 1)


class OnlineLogistic:
    """Softmax regression by stochastic steps over one-hot features, last class as reference, L2 decay applied when a weight is used.

    ``held`` maps a feature to when it was used last and its weights; any mapping will do,
    so that a stream can keep it in its state.
    """

    def __init__(self, classes: list[str], rate: float = 0.05, decay: float = 0.001, held: MutableMapping[str, tuple[int, list[float]]] | None = None, t: int = 0) -> None:
        self.classes, self.rate, self.decay = classes, rate, decay
        self.held = {} if held is None else held
        self.t = t

    def step(self, features: dict[str, float], y: str) -> list[float]:
        """The posterior before the row, then one gradient step."""
        k = len(self.classes) - 1
        self.t += 1
        shrink = 1 - self.rate * self.decay
        now: dict[str, list[float]] = {}
        for f in features:
            when, w = self.held.get(f) or (self.t, [0.0] * k)
            now[f] = [x * shrink ** (self.t - when) for x in w] if when < self.t else list(w)
        z = [sum(now[f][i] * v for f, v in features.items()) for i in range(k)] + [0.0]
        top = max(z)
        e = [math.exp(x - top) for x in z]
        p = [x / sum(e) for x in e]
        for i in range(k):
            g = (1.0 if self.classes[i] == y else 0.0) - p[i]
            for f, v in features.items():
                now[f][i] += self.rate * g * v
        for f, w in now.items():
            self.held[f] = (self.t, w)
        return p

    def predict(self, values: dict[str, object], y: str) -> tuple[str, int]:
        """The class before the row and whether it errs; then the row is learnt. Values become features "name=value"."""
        p = self.step({"": 1.0} | {f"{a}={v}": 1.0 for a, v in values.items()}, y)
        pred = self.classes[max(range(len(p)), key=lambda i: (round(p[i], 12), -i))]
        return pred, int(pred != y)


class MemberWeights:
    """Weights of AODE's members: a member grows by its share of the truth times the vote's error, once ``start`` rows are counted."""

    def __init__(self, members: int, classes: int, start: int = 100) -> None:
        self.w = np.full(members, 1.0 / members)
        self.classes, self.start, self.seen = classes, start, 0

    def step(self, logs: np.ndarray, at: int, own: bool = False) -> np.ndarray:
        """The weighted vote's posterior, then the update; ``logs[member, class]`` with NaN rows where a value is unseen.

        With ``own`` the row itself is in the counts already.
        """
        active = ~np.isnan(logs[:, 0])
        if not active.any():
            self.seen += 1
            return np.full(self.classes, 1.0 / self.classes)
        joint = np.exp(logs[active] - logs[active].max())
        p = self.w[active] @ joint
        p = p / p.sum()
        if self.seen + own > self.start:
            e = np.exp(logs[active] - logs[active].max(1, keepdims=True))
            self.w[active] *= 1.0 + (1.0 - p[at]) * (e[:, at] / e.sum(1)) / len(self.w)
            self.w /= self.w.sum()
        self.seen += 1
        return p


def in_order(rows: DataFrame, make: Callable[[object], Callable[[dict], tuple]], schema: str, part: str = "part", seq: str = "seq") -> DataFrame:
    """What ``make(part)(row)`` gives for every row, in the order of ``seq`` within each part.

    Parts are dealt to tasks and sorted there (Spark spills what does not fit); a task holds
    one batch of rows and the state of one part, however many rows a part has. Steps that
    build on each other cannot be reordered, so it is parts that run side by side.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step, kinds = object(), None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row[part] != now:
                    now = row[part]
                    step = make(now)
                out.append(step(row))
            if out:
                kinds = kinds or _arrow_types(schema)
                yield pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.repartition(part).sortWithinPartitions(part, seq).mapInArrow(run, schema)


def _arrow_types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return [kinds[c.split()[1]] for c in schema.split(", ")]


class BinProcessor(StatefulProcessor):
    """One attribute's bins per key; the state is what the bins hold, at most ``window`` values."""

    def __init__(self, bins: int = 5, window: int = 1000, sampled: bool = False) -> None:
        self.bins, self.window, self.sampled = bins, window, sampled

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "said string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bins = (SampledBins if self.sampled else SlidingBins)(self.bins, self.window)
        if self.state.exists():
            bins.load(self.state.get()[0])
        frame = pd.concat(list(rows)).sort_values("seq")
        codes = [bins.step(v) for v in frame["value"]]
        self.state.update((bins.dump(),))
        yield pd.DataFrame({"att": [key[0]] * len(frame), "seq": frame["seq"].to_numpy(), "code": codes})

    def close(self) -> None:
        pass


def stream_bins(stream: DataFrame, bins: int = 5, window: int = 1000, sampled: bool = False) -> DataFrame:
    """(att, seq, code) of a streaming (att, seq, value): state per attribute, so attributes run side by side."""
    return stream.groupBy("att").transformWithStateInPandas(BinProcessor(bins, window, sampled), "att string, seq long, code long", "Append", "None")


def batch_bins(rows: DataFrame, kind: str = "sliding", bins: int = 5, window: int = 1000, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The same for a finished stream, one sequential pass per attribute."""

    def make(att: str) -> Callable[[dict], tuple]:
        b = SlidingBins(bins, window) if kind == "sliding" else SampledBins(bins, window) if kind == "sampled" else PartitionIncremental(low, high, bins)
        return lambda r: (att, r["seq"], b.step(r["value"]))

    return in_order(rows.select("att", F.col("seq").cast("long").alias("seq"), F.col("value").cast("double").alias("value")), make, "att string, seq long, code long", "att")


def running_counts(stream: DataFrame, atts: list[str]) -> DataFrame:
    """Count cubes of a stream: the incremental training of every count learner (complete or update mode)."""
    long = stream.select("y", F.explode(F.array(*(F.struct(F.lit(a).alias("att"), F.col(a).alias("val")) for a in atts))).alias("e"))
    return long.groupBy("e.att", "e.val", "y").agg(F.count("*").alias("n"))


def prequential_logistic(rows: DataFrame, atts: list[str], classes: list[str], rate: float = 0.05, decay: float = 0.001) -> DataFrame:
    """(part, seq, y, pred, error): test-then-train softmax regression, one ordered pass per ``part``."""

    def make(part: int) -> Callable[[dict], tuple]:
        model = OnlineLogistic(classes, rate, decay)
        return lambda r: (part, r["seq"], r["y"], *model.predict({a: r[a] for a in atts}, r["y"]))

    return in_order(rows.select(F.col("part").cast("long").alias("part"), F.col("seq").cast("long").alias("seq"), "y", *atts), make, "part long, seq long, y string, pred string, error int")


class _Kept(dict):
    """Weights of the features that a call uses, read from the state when first asked for."""

    def __init__(self, state) -> None:
        super().__init__()
        self.state, self.absent = state, set()

    def get(self, feature, default=None):
        if feature not in self and feature not in self.absent:
            if self.state.containsKey((feature,)):
                when, said = self.state.getValue((feature,))
                self[feature] = (when, json.loads(said))
            else:
                self.absent.add(feature)
        return super().get(feature, default)

    def save(self) -> None:
        for feature, (when, w) in self.items():
            self.state.updateValue((feature,), (when, json.dumps(w)))


class LogisticProcessor(StatefulProcessor):
    """Test-then-train regression over a stream whose rows may come out of order, within the watermark.

    Rows wait in the state, by their time and place, until the watermark has passed them; a
    timer then learns them in order. The model is kept as one entry per feature, of which a
    call reads what its rows use. State is bounded by the features and by what the watermark
    lets wait. A row that is later than the watermark is learnt when it comes.
    """

    def __init__(self, atts: list[str], classes: list[str], rate: float = 0.05, decay: float = 0.001) -> None:
        self.atts, self.classes, self.rate, self.decay = atts, classes, rate, decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.weights = handle.getMapState("weights", "feature string", "used long, said string")
        self.waiting = handle.getMapState("waiting", "at long, seq long", "said string")
        self.steps = handle.getValueState("steps", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = set()
        for frame in rows:
            for r in frame.to_dict("records"):
                at = int(r["ts"].timestamp() * 1000)
                self.waiting.updateValue((at, int(r["seq"])), (json.dumps([r["y"], [r[a] for a in self.atts]]),))
                due.add(max(at, passed + 1))
        for at in due:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted(k for k in self.waiting.keys() if k[0] <= until)
        if not ready:
            return
        kept = _Kept(self.weights)
        model = OnlineLogistic(self.classes, self.rate, self.decay, kept, self.steps.get()[0] if self.steps.exists() else 0)
        out = []
        for k in ready:
            y, values = json.loads(self.waiting.getValue(k)[0])
            out.append((key[0], k[1], y, *model.predict(dict(zip(self.atts, values, strict=True)), y)))
            self.waiting.removeKey(k)
        kept.save()
        self.steps.update((model.t,))
        yield pd.DataFrame(out, columns=["part", "seq", "y", "pred", "error"])

    def close(self) -> None:
        pass


def stream_logistic(stream: DataFrame, atts: list[str], classes: list[str], rate: float = 0.05, decay: float = 0.001) -> DataFrame:
    """``prequential_logistic`` of a streaming (part, seq, ts, y, atts...) with a watermark on ``ts``; seq settles the order within one ts."""
    processor = LogisticProcessor(atts, classes, rate, decay)
    return stream.groupBy("part").transformWithStateInPandas(processor, "part long, seq long, y string, pred string, error int", "Append", "EventTime")


def member_weights(df: DataFrame, atts: list[str], classes: list[str], sizes: dict[str, int], part: str = "part", seq: str = "seq", start: int = 100, own: bool = False, m: float = 1.0) -> DataFrame:
    """(part, seq, y, pred, error, weights): AODE whose members' weights are learnt row by row.

    The members' counts before each row come from running sums that Spark spreads out; what is
    left for the ordered pass of a part is a vote and an update of one number per member. With
    ``own`` a row is counted before it is scored, else after.
    """
    logs = prequential_members(df, atts, classes, sizes, seq, m=m, within=part, own=own)

    def make(_: object) -> Callable[[dict], tuple]:
        weights = MemberWeights(len(atts), len(classes), start)

        def step(r: dict) -> tuple:
            table = np.array(r["logs"], dtype=float).reshape(len(atts), len(classes))
            p = weights.step(table, r["at"], own)
            best = int(np.argmax(np.round(p, 9)))
            return r["part"], r["seq"], classes[r["at"]], classes[best], int(best != r["at"]), weights.w.tolist()

        return step

    given = logs.select(F.col(part).cast("long").alias("part"), F.col(seq).alias("seq"), "at", "logs")
    return in_order(given, make, "part long, seq long, y string, pred string, error int, weights array<double>")


def _pass_on(stretch: DataFrame, seq: str, shape: tuple[int, int], state: tuple[list[float] | None, int], start: int, own: bool) -> tuple[list[float] | None, int]:
    """(weights, rows seen) after the rows of a stretch, in order; only the last state leaves the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = MemberWeights(*shape, start)
        weights.seen = state[1]
        if state[0] is not None:
            weights.w = np.array(state[0])
        for b in batches:
            logs = b.column("logs").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, *shape)
            for table, at in zip(logs, b.column("at").to_pylist(), strict=True):
                weights.step(table, at, own)
        yield pa.RecordBatch.from_arrays([pa.array([weights.w.tolist()], pa.list_(pa.float64())), pa.array([weights.seen], pa.int64())], names=["weights", "seen"])

    last = stretch.select(seq, "at", "logs").coalesce(1).sortWithinPartitions(seq).mapInArrow(run, "weights array<double>, seen long").first()
    return (last.weights, last.seen) if last else state


def fit_weighted_aode(df: DataFrame, atts: list[str], seq: str = "id", start: int = 100, own: bool = False, m: float = 1.0) -> AnDE:
    """AODE with the weights that its members have after the last row; the whole table is one ordered stream.

    Members' logs are computed all over the cluster and stored by stretches of the stream. The
    stretches are gone through one after another, each by a task that reads only its own
    rows; what is handed on is a number per member.
    """
    spark, cells = df.sparkSession, cuboid(df, atts)
    classes, sizes = labels(cells), domain_sizes(cells, atts)
    one = df.select(F.col(seq).cast("long").alias("seq"), "y", *atts)
    n = one.count() // STRETCH_ROWS + 1
    logs = prequential_members(one, atts, classes, sizes, "seq", m=m, own=own).withColumn("stretch", ranges(one, "seq", n))
    path = f"{shared_dir(spark)}/tables/members-{uuid.uuid4().hex}"
    logs.repartitionByRange(n, "stretch").write.partitionBy("stretch").parquet(path)
    stored = spark.read.schema(logs.schema).parquet(path)
    state: tuple[list[float] | None, int] = (None, 0)
    for i in range(n):
        state = _pass_on(stored.where(F.col("stretch") == i), "seq", (len(atts), len(classes)), state, start, own)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    weights = state[0] or [1.0 / len(atts)] * len(atts)
    return AnDE(atts, 1, m, weights={frozenset((a,)): w for a, w in zip(atts, weights, strict=True)})
