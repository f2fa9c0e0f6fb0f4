"""Token ids of whole texts by a public tokenizer file, with a bounded cache of pieces.

A text is split only where the tokenizer always splits too, so the ids of its pieces, joined, are the ids of the text. Frequent pieces are encoded once per Python worker.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable

import numpy as np

from .common import worker_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level tokenizers write for bytes: printable ones stand for themselves, the others are numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


class _Whole(Exception):
    """The text has blanks in a row, at an end, or a mark of ours: it is encoded as a whole."""


class PieceEncoder(dict):
    """``encode(texts)`` gives per text its ids as little-endian unsigned 32-bit bytes: those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    The dictionary holds the ids of pieces; one that is missing is encoded, and kept while there are fewer than ``most`` (about 200 bytes each). style "words": white space separates and is dropped (``word_bpe``). style "bytes": a single blank goes with the piece that follows, a single line end stands alone (``byte_bpe``). A text that may hold an added token of the file, such as its end mark, is encoded as a whole.
    """

    #: Marks a piece before which there is no blank.
    BARE = "\x01"
    #: Marks that the tokenizers keep apart from letters before them, and together.
    MARKS = ".,;:!?#*$%&"

    def __init__(self, path: str, style: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.words, self.most = style == "words", most
        #: How a letter after a blank begins.
        self.blank = "" if self.words else chr(self.letters[32])
        #: The first letters of added tokens.
        self.heads = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():  # most pieces: their bytes are their letters
            ids = array("I", [t.id for t in self.tokenize(piece.lower() if self.words else self.blank + piece)]).tobytes()
        else:
            ids = self._encode(piece)
        if len(self) < self.most:
            self[piece] = ids
        return ids

    def _encode(self, piece: str) -> bytes:
        first = piece[:1]
        bare = not self.words and first in ("\n", self.BARE)
        body = piece[1:] if bare else piece
        if not self.words and (not body or body[0].isspace() or body[-1].isspace() or body[0] == self.BARE):
            raise _Whole
        stem = body.rstrip(self.MARKS)
        # letters only; for "words" those that normalisation leaves as they are but for their case
        if not stem.isalpha() or self.words and max(stem) > "\xff":
            return self._whole(piece if self.words or first == "\n" else body if bare else " " + body)
        if first == "\n" and not self.words:
            return self._marks("\n") + self[self.BARE + body]
        if stem != body:
            return self[(self.BARE if bare else "") + stem] + self._marks(body[len(stem) :])
        text = stem.lower() if self.words else stem if bare else " " + stem
        return array("I", [t.id for t in self.tokenize(text.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _marks(self, marks: str) -> bytes:
        key = self.BARE * 2 + marks  # never a piece
        if not dict.__contains__(self, key):
            self[key] = self._whole(marks)
        return self[key]

    def _text(self, text: str) -> bytes:
        if self.BARE in text or any(head in text for head in self.heads):
            return self._whole(text)
        try:
            if self.words:
                return b"".join(map(self.__getitem__, filter(None, text.replace("\n", " ").split(" "))))
            return b"".join(map(self.__getitem__, (self.BARE + text.replace("\n", " \n")).split(" ")))
        except _Whole:
            return self._whole(text)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        return [self._text(t) if t else b"" for t in texts]


def encoder(path: str, style: str) -> PieceEncoder:
    """The worker's encoder for this file. Byte-level pieces come in more spellings, with and without a blank and in either case: more of them are kept."""
    return worker_cache(("pieces", path, style), lambda: PieceEncoder(path, style, 1_000_000 if style == "bytes" else 400_000))
