"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The distinct marked words of a batch are sorted, which lines them up as the depth-first
order of their trie: each word keeps the forward scores of the prefix it shares with the
one before and only goes on from there. Scores are log probabilities of a Zipf law over the
vocabulary's ranks, log p = -log(rank + 1) (the public model is a BPE one, whose own scores
are just ranks); characters outside the vocabulary fall back to byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory
from .vocabulary import MARK, MODEL_PATH, Vocabulary, load

#: A literal mark in a text; no valid text holds this code point, so it becomes bytes and decodes to itself.
LITERAL = "\ud800"
#: Stands for a piece of one unknown character: this much under the worst score.
UNKNOWN_PENALTY = 10.0
#: A marked word is a run of marks and what follows up to the next one; no piece goes beyond it.
MARKED = re.compile(f"{MARK}+[^{MARK}]*")
#: Words kept from batch to batch.
CACHE = 200_000


def zipf_scores(vocab: Vocabulary) -> dict[str, tuple[float, int]]:
    """Score and id of every normal piece; the rank is the place in the vocabulary."""
    first = min(vocab.ids.values())
    return {p: (-log(i - first + 1), i) for p, i in vocab.ids.items()}


class Encoder:
    def __init__(self, vocab: Vocabulary) -> None:
        self.scores = zipf_scores(vocab)
        self.unknown = min(s for s, _ in self.scores.values()) - UNKNOWN_PENALTY
        # pieces by their last letters, so that the ones ending at a place are found letter by letter: [score, id, longer ones]
        self.ends: dict[str, list] = {}
        for piece, (score, i) in self.scores.items():
            level = self.ends
            for c in reversed(piece):
                node = level.setdefault(c, [None, -1, {}])
                level = node[2]
            node[0], node[1] = score, i
        self.byte_ids = vocab.byte_ids
        normal = set(vocab.ids.values())
        self.bytes_of = [t.replace(MARK, " ").encode() if i in normal else b"" for i, t in enumerate(vocab.texts)]
        for b, i in enumerate(vocab.byte_ids):
            self.bytes_of[i] = bytes([b])
        #: ids of a word as 32-bit numbers
        self.cache: dict[str, bytes] = {}

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Best pieces of each distinct word; ties go to the shorter last piece."""
        ends, unknown = self.ends, self.unknown
        best, back, out, before = [0.0], [(0, -1)], {}, ""
        for word in sorted(set(words)):
            n = len(word)
            at = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                at += 1
            del best[at + 1 :], back[at + 1 :]
            for j in range(at + 1, n + 1):
                i = j - 1
                node = ends.get(word[i])
                if node is None or node[0] is None:
                    top, step = best[i] + unknown, (i, -1)
                else:
                    top, step = best[i] + node[0], (i, node[1])
                while node is not None and i:
                    i -= 1
                    node = node[2].get(word[i])
                    if node is not None and node[0] is not None and best[i] + node[0] > top:
                        top, step = best[i] + node[0], (i, node[1])
                best.append(top)
                back.append(step)
            ids, j = [], n
            while j:
                i, piece = back[j]
                if piece >= 0:
                    ids.append(piece)
                else:
                    c = word[i:j]
                    ids.extend(self.byte_ids[b] for b in reversed((MARK if c == LITERAL else c).encode()))
                j = i
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [MARKED.findall(MARK + t.replace(MARK, LITERAL).replace(" ", MARK)) if t else [] for t in texts]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = self.encode_words(w for w in set(chain.from_iterable(split)) if w not in cache)
        cache.update((w, array("i", ids).tobytes()) for w, ids in new.items())
        return [np.frombuffer(b"".join(map(cache.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text: pieces joined, marks as spaces, bytes as UTF-8, without the space put in front."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]


#: Texts encoded at a time.
STEP = 1000
ENCODED_DDL = "doc_id long, n_chars long, n_pieces long, pieces array<int>, decoded_sha256 string, round_trip boolean"


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """One row per input row: its pieces, and the digest of the text they decode to.

    A null text counts as empty and has no pieces. Any text comes back exactly. Narrow: no
    shuffle, words are shared within a task; ids may be null or repeated, other columns are
    not read.
    """
    vocab = load(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("pieces", pa.list_(pa.int32())), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab)
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                coded = encoder.encode(texts)
                back = [encoder.decode(ids.tolist()) for ids in coded]
                sizes = np.array([0, *map(len, coded)], np.int32).cumsum(dtype=np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(coded) if coded else np.empty(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(len, coded)), pa.int64()), pieces, pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([a == b for a, b in zip(texts, back, strict=True)])],
                    schema=schema,
                )
        del encoder
        release_memory()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, ENCODED_DDL)


def decode_pieces(coded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) of coded rows; null pieces give a null text."""
    vocab = load(model_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab)
        for b in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(pieces_col).alias("pieces")).mapInArrow(run, "doc_id long, text string")
