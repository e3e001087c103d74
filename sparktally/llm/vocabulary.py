"""The fixed public vocabulary that language ID and SentencePiece encoding share."""

from __future__ import annotations

from dataclasses import dataclass

#: A public 32k SentencePiece model; pass another path where it lies elsewhere.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Normal pieces with their ids and ranks, the 256 byte pieces, and every piece's text by id."""

    ids: dict[str, int]
    byte_ids: list[int]
    texts: list[str]
    longest: int


def load(path: str = MODEL_PATH) -> Vocabulary:
    """Read on the driver; tasks get the pieces with their closure and need no file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, byte_ids, texts = {}, [0] * 256, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        texts.append(piece)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ids[piece] = i
    return Vocabulary(ids, byte_ids, texts, max(map(len, ids)))
