"""BPE encoding by backtracking over Aho-Corasick matches; decoding by an offset table.

A word's byte-pair merges end in the one sequence of tokens in which every two
neighbours are *compatible*: merging their joined text again gives the same
two. So a word can be encoded from left to right: take the longest token that
an Aho-Corasick automaton finds here and that is compatible with the one
before; if none is, mark this place as a dead end and step back. Each place is
left at most once for each token that ends there, and answers about pairs are
remembered, so the work grows with the length of the word.

Text is prepared as the tokenizer file says: composed (NFC), white space
dropped, lower case, cut into words by the file's pattern, bytes written in
the printable byte alphabet, the last one of a word marked as its end. The
tokens of special strings are cut out first.

Nulls and empty texts have no tokens and decode to the empty text. Every row is
encoded by itself, repeated ones too; an empty table has no rows. Other columns, of any
name, don't matter. A long text is worked on whole, in time linear in its length.
"""

from __future__ import annotations

import array
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vestige.llm.bpe_cache import byte_alphabet
from vestige.llm.shared import map_batches, own_columns, whole_text

#: Fixed value: Unicode's white space, as the tokenizer's pattern means it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the file's word pattern.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
#: The same where all characters are ASCII.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"
#: The same for text below U+0250, in lower case.
LATIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ0-9\xb2\xb3\xb9\xbc-\xbe]+"
BEYOND_LATIN = re.compile(r"[^\x00-\x1b\x20-\xbf\xd7\xdf-ɏ]")

NEVER = 1 << 60
LONG_WORD = 64


class Vocabulary:
    """Token strings over the byte alphabet, one character a byte; a word's last byte is its end form."""

    def __init__(self, path: str):
        import ahocorasick

        model = json.load(open(path))["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.tokens = [t for t, _ in sorted(model["vocab"].items(), key=lambda x: x[1])]
        ids = model["vocab"]
        self.made_at = [-1] * len(self.tokens)
        self.halves: list[tuple[int, int]] = [(-1, -1)] * len(self.tokens)
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = ids[left + right]
            self.merges[ids[left], ids[right]] = rank
            if self.made_at[whole] < 0:
                self.made_at[whole], self.halves[whole] = rank, (ids[left], ids[right])
        alphabet = byte_alphabet()
        #: A word's last character is moved up by this, so that a token tells where the word ends.
        self.end_shift = 0x1000
        self.inner = alphabet
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            ends = bool(suffix) and token.endswith(suffix)
            core = token[: -len(suffix)] if ends else token
            if core and set(core) <= set(alphabet):
                self.automaton.add_word(core[:-1] + chr(ord(core[-1]) + self.end_shift) if ends else core, (len(core), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge would ever join the end of ``left`` with the start of ``right``.

        Walks back through the making of both. At each moment the two tokens
        that touch are ``a`` and ``b``, until ``a`` or ``b`` is merged into a
        larger one; a merge of the two that comes before that would have won.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, a_until, b_until, good = left, right, NEVER, NEVER, True
        while True:
            rank = self.merges.get((a, b), NEVER)
            if rank < a_until and rank <= b_until:  # among equal ranks the leftmost pair is merged first
                good = False
                break
            if self.made_at[a] < 0 and self.made_at[b] < 0:
                break
            if self.made_at[a] > self.made_at[b]:
                a_until, a = self.made_at[a], self.halves[a][1]
            else:
                b_until, b = self.made_at[b], self.halves[b][0]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[left, right] = good
        return good

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word (characters of the byte alphabet), its last one taken as the end."""
        marked = word[:-1] + chr(ord(word[-1]) + self.end_shift)
        longest = [i for _, (_, i) in self.automaton.iter_long(marked)]
        if all(map(self.compatible, longest, longest[1:])):
            return longest
        return self._backtrack(marked)

    def _backtrack(self, marked: str) -> list[int]:
        starts: list[list[tuple[int, int]]] = [[] for _ in marked]
        for end, (length, i) in self.automaton.iter(marked):
            starts[end - length + 1].append((length, i))
        for choices in starts:
            choices.sort()
        dead = [False] * (len(marked) + 1)
        out: list[int] = []
        places = [0]
        untried = [list(starts[0])]
        while places[-1] < len(marked):
            at, choices = places[-1], untried[-1]
            while choices:
                length, token = choices.pop()
                if not dead[at + length] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    places.append(at + length)
                    untried.append(list(starts[at + length]) if at + length < len(marked) else [])
                    break
            else:
                # Whether a place is a dead end doesn't depend on the token before it if that token is
                # part of a valid encoding; each valid prefix has one encoding only.
                dead[at] = True
                places.pop()
                untried.pop()
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                out.pop()
        return out


class BacktrackingEncoder:
    """Encodes and decodes whole texts as the tokenizer file says; remembers up to ``room`` words."""

    def __init__(self, path: str, room: int = 500_000):
        import regex

        spec = json.load(open(path))
        self.vocabulary = Vocabulary(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cut_ascii, self.cut_latin, self.cut_any = re.compile(ASCII_WORDS).findall, re.compile(LATIN_WORDS).findall, regex.compile(WORDS).findall
        self.alphabet = byte_alphabet()
        self.words: dict[str, bytes] = {}
        self.room, self.missed = room, 0
        # The offset table: token i is self.blob[self.offsets[i] : self.offsets[i + 1]], the space that parts tokens included.
        parts = [(t + " ").encode() for t in self.vocabulary.tokens]
        parts += [b""] * (max(self.special.values(), default=0) + 1 - len(parts))
        for text, i in self.special.items():
            parts[i] = (text + " ").encode()
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            ids = array.array("I", self.vocabulary.encode_word(word.encode().decode("latin-1").translate(self.alphabet)))
            if sys.byteorder != "little":
                ids.byteswap()
            known = ids.tobytes()
            if len(word) <= LONG_WORD:
                if len(self.words) < self.room:
                    self.words[word] = known
                else:
                    self.missed += 1
                    if self.missed > 4 * self.room:
                        self.words.clear()
                        self.missed = 0
        return known

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            words = self.cut_ascii(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
            # Lower case is taken of each character alone: a final sigma is an ordinary one.
            text = text.replace("Σ", "σ").lower()
            words = self.cut_any(text) if BEYOND_LATIN.search(text) else self.cut_latin(text)
        return b"".join(map(self._word, words))

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.special_cut is None or "<|" not in text:
            return self._plain(text)
        return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else self._plain(part) for part in self.special_cut.split(text))

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8: token strings parted by spaces, gathered from the offset table."""
        which = np.frombuffer(ids, "<u4")
        if not len(which):
            return b""
        first, size = self.offsets[which], self.offsets[which + 1] - self.offsets[which]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        return self.blob[at].tobytes()[:-1]


@lru_cache(maxsize=2)
def backtracking_encoder(path: str) -> BacktrackingEncoder:
    return BacktrackingEncoder(path)


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded text (binary, UTF-8) of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = backtracking_encoder(tokenizer)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([encoder.decode(i) for i in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return map_batches(own_columns(docs, "doc_id", "text").withColumn("text", whole_text()), work, "doc_id long, ids binary, decoded binary")


def encoding_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of ``encode_decode``, taken where it runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = backtracking_encoder(tokenizer)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(encoder.decode(i)).hexdigest() for i in ids]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(own_columns(docs, "doc_id", "text").withColumn("text", whole_text()), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
