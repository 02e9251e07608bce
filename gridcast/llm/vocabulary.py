"""Existing SentencePiece vocabularies: pieces, scores and kinds. The file's path is a parameter; only the driver reads it."""

from __future__ import annotations

import os
from typing import NamedTuple

SPACE = "▁"                                               # FIXED: the mark that stands for a space in a piece
DEFAULT_MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


class Piece(NamedTuple):
    text: str
    score: float
    kind: str                                                  # piece, byte, or control (unknown included)


def read_pieces(path: str) -> list[Piece]:
    """The pieces of a model file in order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ((sp.is_byte, "byte"), (sp.is_control, "control"), (sp.is_unknown, "control"), (sp.is_unused, "control"))
    return [Piece(sp.id_to_piece(i), sp.get_score(i), next((name for test, name in kinds if test(i)), "piece"))
            for i in range(sp.get_piece_size())]


class Rules(NamedTuple):
    kind: str                                                  # bpe or unigram
    dummy_prefix: bool


def read_rules(path: str) -> Rules:
    """How a model encodes; models that rewrite the text (a character map, collapsed spaces) are not supported."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models with the identity normaliser and escaped spaces are supported")
    kinds = {1: "unigram", 2: "bpe"}
    if model.trainer_spec.model_type not in kinds:
        raise ValueError("only BPE and unigram models are supported")
    return Rules(kinds[model.trainer_spec.model_type], spec.add_dummy_prefix)
