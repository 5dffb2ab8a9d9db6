"""Whole-text ids of a byte-level tokenizer, with a bounded memory of pieces.

A byte-level tokenizer cuts a text into pre-tokens and merges inside each
one alone, so the ids of a text are the ids of its pre-tokens in order.
Prose repeats its words: remembering the ids of pieces already seen leaves the
tokenizers library only the new ones. The cut is done here with
the standard library's ``re`` for texts whose characters all lie below U+0250,
where the classes are written out; any other text, and any text that holds a
special token, goes to the library whole.
"""

from __future__ import annotations

import array
import re
import sys
from functools import lru_cache

# Letters, numbers and white space below U+0250.
LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = r"\t\n\r \xa0"
# Fixed value: the byte-level cut, its classes as above.
PRETOKENS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
OUTSIDE = re.compile(r"[^\t\n\r -~\xa0-ɏ]")
TWO_SPACES = re.compile(rf"[{SPACE}][{SPACE}]")
LONG_PIECE = 64


def byte_alphabet() -> str:
    """The printable stand-in of every byte, in byte order: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class PieceEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes.

    ``room`` bounds each of the two memories. A full memory takes no more:
    what it met first is what is met most. After four times as many misses it
    starts afresh, in case the texts have changed.
    """

    def __init__(self, path: str, room: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.alphabet = byte_alphabet()
        self.room = room
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda _: None
        self.tokens: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.missed = 0

    def _keep(self, memory: dict[str, bytes], key: str, ids: bytes) -> None:
        if len(key) > LONG_PIECE:
            return
        if len(memory) < self.room:
            memory[key] = ids
            return
        self.missed += 1
        if self.missed > 4 * self.room:
            self.missed = 0
            self.tokens.clear()
            self.pieces.clear()

    def _pack(self, ids: list[int]) -> bytes:
        out = array.array("I", ids)
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def _token(self, token: str) -> bytes:
        known = self.tokens.get(token)
        if known is None:
            known = self._pack([t.id for t in self.merge(token.encode().decode("latin-1").translate(self.alphabet))])
            self._keep(self.tokens, token, known)
        return known

    def _piece(self, piece: str) -> bytes:
        ids = b"".join(map(self._token, PRETOKENS.findall(piece)))
        if "\n" not in piece:
            self._keep(self.pieces, piece, ids)
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if OUTSIDE.search(text) or self.special(text):
            return self._pack(self.library.encode(text, add_special_tokens=False).ids)
        if TWO_SPACES.search(text):
            return b"".join(map(self._token, PRETOKENS.findall(text)))
        # With single spaces only, every space starts a pre-token: the text may be cut there.
        first, *rest = text.split(" ")
        known, piece = self.pieces.get, self._piece
        out = [b"".join(map(self._token, PRETOKENS.findall(first)))]
        for part in rest:
            part = " " + part
            ids = known(part)
            out.append(piece(part) if ids is None else ids)
        return b"".join(out)


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each tokenizer file in a Python worker."""
    return PieceEncoder(path)
