"""The pieces of a public vocabulary file, read on the driver and sent to the executors."""

from __future__ import annotations

import os

#: Where the public tokenizer files lie; a parameter, the files are not part of this repository.
FOLDER = os.environ.get("LEDGERLINE_TOKENIZERS", "/opt/tokenizers")
PIECES = "piece_bpe_32k.model"
SPACE = "▁"


def read_pieces(path: str | None = None) -> tuple[dict[str, tuple[int, float]], dict[int, int]]:
    """({piece: (id, score)} of the ordinary pieces, {byte: id} of the byte pieces) of a SentencePiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or os.path.join(FOLDER, PIECES))
    pieces, octets = {}, {}
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            octets[int(text[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[text] = (i, sp.get_score(i))
    return pieces, octets
