"""Exact ids and counts of a byte-level BPE tokenizer, from a cache of the pieces between single spaces.

A byte-level BPE with the usual pre-token pattern never joins characters across
a single space or line feed that stands between two other characters: every
pre-token ends before it, and nothing to its left is looked at. So a text whose
white space is only such single spaces and line feeds is the concatenation of
its pieces (" word", "\\nword"), each encoded by the library once. Every other
text (runs of white space, other white space, an added token's string in it)
and every other kind of tokenizer takes the library's own path whole."""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

#: Fixed value: the pre-token pattern of this kind of tokenizer.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: White space of either library beside the space and the line feed; and the runs of those two.
_OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (0x20, 0x0A)]
_RUNS = ("  ", "\n\n", " \n", "\n ")
#: Marks that are a token of their own after letters.
_MARKS = frozenset(".,:;!?|")
#: What is neither white space nor a letter nor a number, and so is one token's stretch after a word.
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Cache(dict):
    """piece -> value; two generations, so that it stays below twice `limit` entries and keeps what is in use."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old, self.marks = make, limit, {}, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece, True)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value

    def mark(self, text: str):
        """The value of a text that no space comes before; all are forgotten at an eighth of `limit`."""
        if (value := self.marks.get(text)) is None:
            if len(self.marks) >= max(1, self.limit // 8):
                self.marks.clear()
            value = self.marks[text] = self.make(text)
        return value


class Encoder:
    def __init__(self, path: str, cache: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):  # the library's own cache of words; pieces are kept here, so it is asked in vain
            model._resize_cache(0)
        self.tokenize = model.tokenize
        told = json.loads(self.tokenizer.to_str())
        pre = told.get("pre_tokenizer") or {}
        self.split = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not told["model"].get("dropout")
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: How codes() writes an id: type codes of array and of numpy.
        self.kind, self.wide = ("H", "<u2") if self.size <= 1 << 16 else ("I", "<u4")
        self.pieces = _Cache(self._encode, cache)
        self._single: set[str] | None = None
        self.counts = _Cache(self._count, cache)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _merge(self, pre: str) -> list[int]:
        """Ids of one pre-token, by the library's merges."""
        return [x.id for x in self.tokenize(pre.encode().decode("latin-1").translate(_SHOWN))]

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def _encode(self, piece: str, spaced: bool = False) -> bytes:
        """The packed ids of a piece, after a space unless it begins with a line feed."""
        if spaced and self.split and piece:
            plain = piece.isascii()
            if plain and piece.isalpha():  # one pre-token, whose bytes are shown as they are, but for the space
                return array(self.kind, [x.id for x in self.tokenize("\u0120" + piece)]).tobytes()
            if plain or max(piece) <= "\xff":
                line = piece[0] == "\n"
                rest = piece[1:] if line else piece
                word = rest.rstrip(_PUNCTUATION)
                if word.isalpha() or word.isascii() and word.isdigit():  # a line feed, a word and its marks are a pre-token each
                    if line:
                        found = self.pieces.mark("\n") + self._packed(self._merge(word))
                    elif len(word) == len(rest):
                        return self._packed(self._merge(" " + word))
                    else:
                        found = self.pieces[word]
                    return found + self.pieces.mark(rest[len(word) :]) if len(word) < len(rest) else found
            elif piece[0] != "\n" and piece[-1] in _MARKS and piece[:-1].isalpha():
                return self.pieces[piece[:-1]] + self.pieces.mark(piece[-1])
        if spaced and piece[:1] != "\n":
            piece = " " + piece
        if not self.split or (not piece.isascii() and max(piece) > "\xff"):  # the classes of other characters are the library's own
            return self._packed(self._whole(piece))
        ids: list[int] = []
        for pre in PRE_TOKEN.findall(piece):
            ids += self._merge(pre)
        return self._packed(ids)

    def parts(self, text: str) -> list[str] | None:
        """The pieces after the first one's leading character, or None where the text must be encoded whole."""
        if not self.split or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _RUNS) or any(x in text for x in _OTHER_SPACE) or any(x in text for x in self.special):
            return None
        return text.replace("\n", " \n").split(" ")

    def codes(self, text: str | None) -> bytes:
        """Ids of a whole text in little-endian integers of kind `wide`; a null is empty."""
        if not text:
            return b""
        if (found := self.parts(text)) is None:
            return self._packed(self._whole(text))
        return self._encode(found[0]) + b"".join(map(self.pieces.__getitem__, found[1:]))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; a null is empty."""
        return np.frombuffer(self.codes(text), self.wide).astype("<u4").tobytes()

    # Counting: whole-token shortcut.

    @property
    def single(self) -> set[str]:
        """Vocabulary strings that the library, asked for each one, encodes as that one id."""
        if self._single is None:
            found = {}
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                try:
                    found[bytes(_BYTE_OF[c] for c in token).decode()] = i
                except (KeyError, UnicodeDecodeError):  # not a whole text of its own
                    continue
            texts = list(found)
            coded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            self._single = {t for t, e in zip(texts, coded, strict=True) if e.ids == [found[t]]}
        return self._single

    def _count(self, piece: str, spaced: bool = False) -> int:
        """Ids of a piece, after a space unless it begins with a line feed."""
        if spaced and piece[:1] != "\n":
            if self.split and piece[-1:] in _MARKS and piece[:-1].isalpha():
                return self.counts[piece[:-1]] + 1
            piece = " " + piece
        if not self.split or (not piece.isascii() and max(piece) > "\xff"):
            return len(self._whole(piece))
        return sum(1 if pre in self.single else len(self._merge(pre)) for pre in ((piece,) if piece[:1] == " " and piece[1:].isalpha() else PRE_TOKEN.findall(piece)))

    def count(self, text: str | None) -> int:
        """Number of ids of a whole text."""
        if not text:
            return 0
        if (found := self.parts(text)) is None:
            return len(self._whole(text))
        return self._count(found[0]) + sum(map(self.counts.__getitem__, found[1:]))


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is visible, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


_BYTE_OF = {c: b for b, c in enumerate(byte_characters())}
_SHOWN = dict(enumerate(byte_characters()))

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
