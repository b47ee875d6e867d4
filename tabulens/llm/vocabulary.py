"""A tokenizer's vocabulary file as a unigram model, for the operators that need its pieces.

The public files at hand that list pieces with scores are of the BPE kind. Their pieces and scores
are read as a unigram model, whose best segmentation has the highest total score. A file of the BPE
kind gives pieces that it never makes by merging (runs of spaces) a score of -1e9, beside which the
library's single-precision sums lose the differences of ordinary scores; as unigrams they count
FLOOR instead. The library itself, given the same file with its kind set to unigram and with
that floor, is what results are tested against.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import regex
from sentencepiece import sentencepiece_model_pb2 as model_pb2

DEFAULT_PATH = os.environ.get("TABULENS_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
SPACE = "▁"
#: Fixed value: what an unknown character costs below the least score.
UNKNOWN_COST = 10.0
#: The least score of a piece: below that of any ordinary unit's letters, and such that sums stay exact in single precision.
FLOOR = -1e6
#: Tried in order: how a text falls into units that no piece crosses.
UNITS = (rf"{SPACE}*[\p{{L}}\p{{M}}]+|{SPACE}*[^\p{{L}}\p{{M}}{SPACE}\n]+|{SPACE}+|\n", rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


@dataclass(frozen=True)
class Vocabulary:
    """pieces: piece to (id, score). units: a pattern, of Java and of the regex module, whose matches
    make up any text, so that each can be segmented alone. byte_ids: id of each byte, or empty.
    scores: by id, the unknown character's too."""

    pieces: dict[str, tuple[int, float]]
    names: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    unknown_id: int
    unknown_score: float
    longest: int
    units: str


def load(path: str = DEFAULT_PATH) -> Vocabulary:
    """Read on the driver, once; the file's size does not depend on the corpus."""
    proto = model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    normal = model_pb2.ModelProto.SentencePiece.NORMAL
    spec = proto.normalizer_spec
    if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only vocabularies that leave texts as they are, but for a leading space, are supported")
    pieces = {p.piece: (i, max(p.score, FLOOR)) for i, p in enumerate(proto.pieces) if p.type == normal}
    kind = {t: [i for i, p in enumerate(proto.pieces) if p.type == t] for t in (2, 6)}
    for units in UNITS:
        whole = regex.compile(units)
        if all(whole.fullmatch(p) for p in pieces):
            break
    else:
        raise ValueError("a piece crosses a space or a line end")
    unknown = min(s for _, s in pieces.values()) - UNKNOWN_COST
    scores = tuple(unknown if i == kind[2][0] else max(p.score, FLOOR) for i, p in enumerate(proto.pieces))
    return Vocabulary(
        pieces, tuple(p.piece for p in proto.pieces), scores, tuple(kind[6]), kind[2][0],
        unknown, max(map(len, pieces)), units,
    )


def as_unigram(path: str = DEFAULT_PATH) -> bytes:
    """The file with its kind set to unigram and its scores floored, for the library itself."""
    proto = model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, FLOOR)
    return proto.SerializeToString()
