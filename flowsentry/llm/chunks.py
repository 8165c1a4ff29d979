"""Encode texts through a bounded cache of the pieces they are made of.

A byte-level pre-tokeniser never joins characters across a blank or line feed between two visible
characters (the blank opens the next piece), nor across a full stop or comma behind a letter or
digit. Texts may therefore be cut there, each distinct piece encoded once, and the ids joined:
these are the ids of the whole text. A text in which one of the four signs stands anywhere else,
or that holds other white space or signs beyond ASCII, is cut by pattern at safe places only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

LONGEST_PIECE = 64  # signs of a piece that is worth keeping
ENTRY_BYTES = 200  # of an entry besides the text and the ids
_CUT = "\x00"
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n][!-~])")


def _kind(byte: int) -> str:
    char = chr(byte)
    if byte >= 0x80 or char.isalnum():
        return "a"
    return " " if char in " \n" else "." if char in ".," else "!" if 0x21 <= byte <= 0x7E else "x"


_KINDS = "".join(map(_kind, range(256))).encode()
_UNSAFE = (b"x", b"  ", b" .", b"..", b"!.")


class UnsafePiece(ValueError):
    """The piece holds a sign that might be white space or join its neighbours."""


class PieceCache(dict):
    """Encoded pieces, of ``limit`` bytes at most; long ones are not kept."""

    def __init__(self, encode_piece: Callable[[str], bytes], limit: int):
        self.encode_piece, self.limit, self.size = encode_piece, limit, 0

    def __missing__(self, piece: str) -> bytes:
        if not piece.isascii() and any(c > "\x7f" and not c.isalnum() for c in piece):
            raise UnsafePiece
        value = self.encode_piece(piece)
        if len(piece) <= LONGEST_PIECE:
            self.size += ENTRY_BYTES + len(piece) + len(value)
            if self.size > self.limit:
                self.clear()
                self.size = 0
            self[piece] = value
        return value


class ChunkEncoder:
    """``encode_piece`` turns a string into bytes; ``encode`` does so for long texts.

    The cache holds ``limit`` bytes; it starts again when full, which costs time only.
    """

    def __init__(self, encode_piece: Callable[[str], bytes], limit: int = 128 << 20):
        self.encode_piece = encode_piece
        self.cache = PieceCache(encode_piece, limit)

    def encode(self, text: str) -> bytes:
        kinds = text.encode().translate(_KINDS)
        if not any(pair in kinds for pair in _UNSAFE):
            marked = text
            for sign in " \n.,":
                marked = marked.replace(sign, _CUT + sign)
            try:
                return b"".join(map(self.cache.__getitem__, marked.split(_CUT)))
            except UnsafePiece:
                pass
        return b"".join(map(self.encode_piece, _SAFE.split(text)))


def is_word(piece: str) -> bool:
    """Is this piece one pre-token of letters, with or without a blank in front?"""
    return piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha())


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write visible Latin-1 characters as they are, the rest from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
