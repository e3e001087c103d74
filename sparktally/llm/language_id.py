"""Language ID by unigram piece models, marginalised over segmentations.

Every language has a probability for each piece of a fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, by a forward pass; a text's is
the product over its words. The probabilities are fitted by expectation-maximisation over
the words of a bounded sample of labelled documents, the counting done by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release_memory
from .vocabulary import MARK, MODEL_PATH, load

#: Labelled documents of a language that fitting uses, about; taken by a hash of id and text.
SAMPLE_PER_LANGUAGE = 1500
EM_ROUNDS = 2
#: Probability of a character outside the vocabulary, under any language.
UNKNOWN = 1e-7
#: Longer words are cut into stretches of so many characters, so that products stay in range.
STRETCH = 32
#: A word: letters and combining marks, a letter among them; the same for fitting and scoring.
WORD = r"\p{M}*\p{L}[\p{L}\p{M}]*"
WORDS = regex.compile(WORD)
ASCII_WORDS = re.compile(r"[A-Za-z]+")
#: Words scored at a time.
BLOCK = 20_000
CACHE = 120_000


class Lattice:
    """Pieces in a hash table keyed by a rolling hash of their code points; looked up for many words at once."""

    BITS = 18
    A = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]) -> None:
        self.longest = max(map(len, pieces))
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.slots = np.zeros(1 << self.BITS, np.uint64)
        self.value = np.full(1 << self.BITS, len(pieces), np.int32)
        self.probes = 1
        for i, k in enumerate(keys.tolist()):
            at, tries = k >> (64 - self.BITS), 1
            while self.slots[at]:
                at, tries = (at + 1) % (1 << self.BITS), tries + 1
            self.slots[at], self.value[at] = k, i
            self.probes = max(self.probes, tries)

    @classmethod
    def _key(cls, piece: str) -> int:
        h, a = 0, int(cls.A)
        for c in piece:
            h = ((h ^ ord(c)) * a) & (2**64 - 1)
            h ^= h >> 29
        return (h * a) & (2**64 - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers; one past the last for what is no piece."""
        at = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.full(len(keys), self.value.max(), np.int32)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            slot = self.slots[at]
            same = slot == keys[left]
            out[left[same]] = self.value[at[same]]
            go = ~same & (slot != 0)
            if not go.any():
                break
            left, at = left[go], (at[go] + 1) % (1 << self.BITS)
        return out

    def edges(self, words: list[str]) -> dict[int, dict[tuple[int, int], np.ndarray]]:
        """Words of one length as a matrix: for (start, end) the piece number of each word's substring."""
        n = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
        out = {}
        for i in range(n):
            h = np.zeros(len(words), np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = (h ^ chars[:, j]) * self.A
                h ^= h >> np.uint64(29)
                out[i, j + 1] = self.find(h * self.A)
        return out


def stretches(word: str) -> list[str]:
    """A word with its mark, in pieces of at most STRETCH characters."""
    w = MARK + word
    return [w[i : i + STRETCH] for i in range(0, len(w), STRETCH)]


def forward(lattice: Lattice, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word) for each language, summed over segmentations. ``probs``: a row per piece, the last one for none."""
    out = np.empty((len(words), probs.shape[1]))
    for pick, e in _by_length(lattice, words):
        f = _sums(e, probs, len(words[pick[0]]), len(pick))
        out[pick] = np.log(f[-1])
    return out


def _by_length(lattice: Lattice, words: list[str]):
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        every = np.flatnonzero(sizes == n)
        for at in range(0, len(every), 4096):
            pick = every[at : at + 4096]
            yield pick, lattice.edges([words[i] for i in pick])


def _sums(e: dict, probs: np.ndarray, n: int, rows: int) -> list[np.ndarray]:
    f = [np.ones((rows, probs.shape[1]))] + [np.zeros((rows, probs.shape[1])) for _ in range(n)]
    none = len(probs) - 1
    for (i, j), piece in sorted(e.items()):
        if j == i + 1:
            f[j] += f[i] * np.where((piece == none)[:, None], UNKNOWN, probs[piece])
            continue
        hit = np.flatnonzero(piece != none)
        if len(hit):
            f[j][hit] += f[i][hit] * probs[piece[hit]]
    return f


def expected_counts(lattice: Lattice, probs: np.ndarray, words: list[str], weight: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over all segmentations of the weighted words, for one language's ``probs`` (pieces x 1)."""
    none = len(probs) - 1
    total = np.zeros(len(probs))
    for pick, e in _by_length(lattice, words):
        n = len(words[pick[0]])
        f = _sums(e, probs, n, len(pick))
        b = [np.zeros((len(pick), 1)) for _ in range(n)] + [np.ones((len(pick), 1))]
        for (i, j), piece in sorted(e.items(), reverse=True):
            p = np.where((piece == none)[:, None], UNKNOWN if j == i + 1 else 0.0, probs[piece])
            b[i] += p * b[j]
            share = (f[i] * p * b[j] / f[n])[:, 0] * weight[pick]
            np.add.at(total, piece, share)
    total[none] = 0
    return total


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    #: a row per piece and one of zeros, a column per language
    probs: np.ndarray
    log_prior: np.ndarray


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", model_path: str = MODEL_PATH, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on about ``per_language`` documents of each language (all, where there are fewer).

    What reaches the driver is a row per language and the expected counts, at most one for
    each language and piece of the fixed vocabulary. Null labels and texts are left out.
    """
    pieces = sorted(load(model_path).ids)
    d = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 20)).alias("h"))
    counts = {r.lang: r.n for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    limits = F.create_map(*(F.lit(x) for k in languages for x in (k, int((1 << 20) * min(1.0, per_language / counts[k])))))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), 1)).alias("word")
    words = materialise(d.where(F.col("h") < limits[F.col("lang")]).select("lang", word).groupBy("lang", "word").agg(F.count("*").alias("n")), "langwords")

    k, none = len(languages), len(pieces)
    probs = np.full((none + 1, k), 1.0 / none)
    probs[none] = 0
    for _ in range(EM_ROUNDS):
        now = probs

        def expect(batches: Iterable[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            lattice, sums = Lattice(pieces), np.zeros((none + 1, k))
            for b in batches:
                cut: list[list] = [[] for _ in languages]
                for lang, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    cut[languages.index(lang)] += [(s, n) for s in stretches(word)]
                for at, found in enumerate(cut):
                    if found:
                        sums[:, at] += expected_counts(lattice, now[:, at : at + 1], [s for s, _ in found], np.array([n for _, n in found], float))
            piece, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_pydict({"piece": piece, "lang": lang, "n": sums[piece, lang]})
            release_memory()

        sums = np.zeros((none + 1, k))
        for r in words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():
            sums[r.piece, r.lang] = r.n
        probs = (sums + 0.02) / (sums.sum(axis=0) + 0.02 * none)
        probs[none] = 0
    discard(words)
    total = sum(counts.values())
    return LanguageModel(languages, pieces, probs, np.log([counts[x] / total for x in languages]))


class Scorer:
    def __init__(self, model: LanguageModel) -> None:
        self.model, self.lattice = model, Lattice(model.pieces)
        self.number: dict[str, int] = {}
        self.table = np.empty((0, len(model.languages)))

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), BLOCK):
            block = new[at : at + BLOCK]
            cut = [stretches(w) for w in block]
            rows = forward(self.lattice, self.model.probs, [s for c in cut for s in c])
            starts = np.cumsum([0, *map(len, cut)][:-1])
            self.table = np.concatenate([self.table, np.add.reduceat(rows, starts)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.model.languages:
            return langs, score
        if len(self.number) > CACHE:
            self.number, self.table = {}, self.table[:0]
        number, new, rows, ids, sizes = self.number, [], [], [], []
        for r, text in enumerate(texts):
            found = (ASCII_WORDS if text.isascii() else WORDS).findall(text.lower()) if text else ()
            if not found:
                continue
            for w in found:
                k = number.get(w)
                if k is None:
                    number[w] = k = len(number)
                    new.append(w)
                ids.append(k)
            rows.append(r)
            sizes.append(len(found))
        if not rows:
            return langs, score
        self._learn(new)
        starts = np.cumsum([0, *sizes][:-1])
        logp = np.add.reduceat(self.table[ids], starts) + self.model.log_prior
        logp -= logp.max(axis=1, keepdims=True)
        p = np.exp(logp)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for r, b in zip(rows, best, strict=True):
            langs[r] = self.model.languages[b]
        score[rows] = p[np.arange(len(rows)), best]
        return langs, score


STEP = 500


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability; ``und`` and 0 for texts that are null or have no letter.

    Numerals and letters of number forms are no letters. Texts of any length are scored whole; of
    equally likely languages the first by name is told. Repeated rows fare alike, an empty table comes
    back empty, and a model of no language tells ``und``. Columns of ``docs`` named as the added ones give way.
    """

    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for texts in batches:
            langs, scores = [], []
            for at in range(0, len(texts), STEP):
                lang, score = scorer.predict(texts.slice(at, STEP).to_pylist())
                langs += lang
                scores += score.tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])
        del scorer
        release_memory()

    d = docs.withColumn("_said", predict(F.col(text_col).cast("string")))
    return d.withColumn(lang_as, F.col("_said.lang")).withColumn(score_as, F.col("_said.score")).drop("_said")


def held_out(id_col: str = "doc_id"):
    """Documents that fitting never sees: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
