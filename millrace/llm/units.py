"""Public tokenizers inside tasks, and what they give for the units of texts, which repeat."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa

#: Most units kept for reuse in a worker (twice as many at times), and the longest unit that is kept.
MOST, LONGEST = 200_000, 64
#: Characters of a text that are split into units at once; a unit is never cut.
SLICE = 1 << 20


def place(name: str) -> str:
    """The file of a public tokenizer by its name; a path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Units(dict):
    """unit -> what ``make`` gives for it. Of short units those seen last are kept, at most 2 * ``most``."""

    def __init__(self, make: Callable[[str], object], most: int = MOST):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, unit: str):
        value = self.before.get(unit)
        if value is None:
            value = self.make(unit)
        if len(unit) <= LONGEST:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[unit] = value
        return value


def texts(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column one at a time; null gives the empty text, bytes that are no UTF-8 a replacement character."""
    return ((v.as_py() or b"").decode("utf-8", "replace") for v in column.cast(pa.binary()))


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``size`` characters that end before a single blank, which is left out."""
    begin = 0
    while len(text) - begin > size:
        end = text.find(" ", begin + size)
        while end > 0 and (text[end - 1].isspace() or text[end + 1 : end + 2].isspace()):
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[begin:end]
        begin = end + 1
    yield text[begin:]


@lru_cache(maxsize=4)
def tokenizer(name: str, plain: bool):
    """A tokenizer of the ``tokenizers`` library; ``plain``: strings of special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(place(name))
    t.encode_special_tokens = plain
    return t


@lru_cache(maxsize=2)
def pieces(name: str):
    """A sentencepiece model and the bytes of its pieces by id; None for pieces that are no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=place(name))
    of = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            of.append(bytes([int(piece[3:-1], 16)]))
        else:
            of.append(None if sp.is_control(i) or sp.is_unknown(i) else piece.replace("▁", " ").encode())
    return sp, of


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable characters of Latin-1 stand for their own byte, the others are 256 onwards in order.
    """
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def byte_level(name: str) -> list[bytes]:
    """The bytes of a byte-level tokenizer's entries by id."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    t = tokenizer(name, True)
    return [bytes(byte_of.get(c, 0) for c in t.id_to_token(i) or "") for i in range(t.get_vocab_size())]
