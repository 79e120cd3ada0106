"""Vocabulary files of public tokenizers, read on the driver and broadcast."""

from __future__ import annotations

from pathlib import Path

SPACE_MARK = "▁"
#: Where the default piece model lies; every operator takes another path.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read_pieces(path: str) -> dict:
    """Pieces with score and id, byte pieces and unknown id of a SentencePiece model.

    Models that normalise text, or that lack the leading space mark, are refused.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = {i for i in ids if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)}
    probe = " Ａ  é b "
    if model.decode(model.encode(probe)) != probe:
        raise ValueError("the model normalises text")
    return {
        "pieces": {model.id_to_piece(i): (i, model.get_score(i)) for i in ids if i not in special},
        "bytes": {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)},
        "unknown": model.unk_id(),
    }


def read_wordpieces(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that continue one.

    A ``.model`` file marks beginnings by its space mark; any other file lists
    a piece per line and marks continuations by ``##``.
    """
    if path.endswith(".model"):
        pieces = list(read_pieces(path)["pieces"])
        first = [p[1:] for p in pieces if p.startswith(SPACE_MARK)]
        rest = [p for p in pieces if not p.startswith(SPACE_MARK)]
    else:
        pieces = Path(path).read_text(encoding="utf-8").split("\n")
        first = [p for p in pieces if not p.startswith("##")]
        rest = [p[2:] for p in pieces if p.startswith("##")]
    return [p for p in first if p], [p for p in rest if p]
