"""Exact whole-text token ids from per-word caches.

A text is cut only where the tokenizer's own pre-tokenization can never join two sides, so the ids of the parts,
one after another, are the ids of the text. Each part's ids are kept in a bounded per-worker table; a part that is
not there yet is encoded by the library. Parts longer than ``LONG`` are always encoded afresh.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

from .common import tokenizer_path, worker_state

LONG = 64
#: Entries in each of a worker's two generations: a full young one becomes the old one, which is then forgotten.
ROOM = 300_000

def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself where it is visible, else one from 256 up."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: Letters, then punctuation without an apostrophe: two pre-tokens at least, cut between the two.
TAIL = re.compile(r"([^\W\d_]+)([.,!?;:#$%&*]+)")
#: A line end between other characters is a pre-token.
LINE_END = re.compile(r"(?<=\S)\n(?=\S)")
#: Below it no character is changed by NFC or, but for the dotted capital I, lowered to more than one.
LATIN = "\u0250"


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class _Odd(Exception):
    """A part that white space begins or ends, or an empty one: the text wasn't cut between other characters."""


class _Parts(dict):
    """``lead`` (nothing or a blank) and a part -> its ids. Made from known parts where the pre-tokenizer cuts anyway."""

    def __init__(self, owner: WordIds, lead: str):
        super().__init__()
        self.owner, self.lead, self.old = owner, lead, {}
        self.mark = BYTE_LETTERS[32] if lead else ""

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            if self.owner.spaced and (not part or part[0].isspace() or part[-1].isspace()):
                raise _Odd  # never kept, so it is found each time
            ids = self._made(part)
        if len(part) <= LONG:
            if len(self) >= self.owner.room:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def _made(self, part: str) -> bytes:
        owner = self.owner
        if owner.spaced and "\n" in part and "<|" not in part:
            head, *rest = LINE_END.split(part)
            if rest:
                return self[head] + b"".join([owner.line_end + owner.first[line] for line in rest])
        if len(part) <= LONG:
            if part.isalpha():
                if owner.spaced:
                    return owner.letters(part, self.mark)
                if part.isascii() or (max(part) < LATIN and "İ" not in part):
                    return owner.letters(part.lower(), "")
            elif cut := TAIL.fullmatch(part):
                return self[cut[1]] + owner.first[cut[2]]
        return owner.encode(self.lead + part)


class WordIds:
    """``ids(text)`` gives the little-endian 32-bit ids of ``text``, as ``encode(text, add_special_tokens=False)``.

    ``spaced``: a word's leading blank belongs to it (byte-level BPE); else white space is dropped between words, and
    letters are lowered. Null counts as the empty text.
    """

    CUT = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str, spaced: bool, room: int = ROOM):
        self.tokenizer, self.spaced, self.room = _library(path), spaced, room
        self.model = self.tokenizer.model
        self.first = _Parts(self, "")
        self.later = _Parts(self, " ") if spaced else self.first
        self.line_end = self.encode("\n")

    def encode(self, part: str) -> bytes:
        return np.asarray(self.tokenizer.encode(part, add_special_tokens=False).ids if part else [], "<u4").tobytes()

    def letters(self, word: str, mark: str) -> bytes:
        """Ids of one pre-token, ``mark`` (nothing or a blank's letter) and letters, by the library's BPE model itself."""
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(mark + spelt)]
        return PACK[len(ids)](*ids) if len(ids) < 32 else np.asarray(ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.spaced:
            if "<|" not in text and _latin(text):
                text = text.lower()
            return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.later.__getitem__, rest))
        except _Odd:
            return b"".join(map(self.encode, self.CUT.split(text)))


def word_ids(name: str, spaced: bool, room: int = ROOM) -> WordIds:
    """The worker's own instance for a tokenizer's file; ``room`` bounds its tables (about 300 bytes an entry)."""
    return worker_state(("ids", name, spaced, room), lambda: WordIds(tokenizer_path(name), spaced, room))


class PieceCounts(dict):
    """Number of SentencePiece BPE pieces of a blank and a pre-token; the frequent ones come ready in ``known``."""

    def __init__(self, path: str, known: dict[str, int]):
        import sentencepiece

        super().__init__(known)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known, self.old = known, {}

    def __missing__(self, part: str) -> int:
        n = self.old.get(part)
        if n is None:
            n = len(self.model.encode(part)) if part else 1  # an empty part is the blank alone
        if len(part) <= LONG:
            if len(self) >= len(self.known) + ROOM:
                self.old = dict(self)
                self.clear()
                self.update(self.known)
            self[part] = n
        return n


#: A blank after something else than a blank; no piece holds a blank after another character.
PIECE_CUT = re.compile("(?<=[^ ▁]) ")


def pre_tokens(text: str) -> list[str]:
    """Parts of a non-empty text that a SentencePiece BPE model with escaped blanks encodes one by one."""
    if "  " in text or "▁" in text or text[0] == " ":
        return PIECE_CUT.split(text)
    return text.split(" ")
