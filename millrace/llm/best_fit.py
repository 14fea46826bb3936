"""Bounded-space best-fit packing: documents as token ids, cut only where they are too long, in sequences.

A task tokenizes its rows and packs their pieces as they come. It keeps a fixed number of open
sequences in a bitset keyed by free space: the lowest set bit at or above a piece's length is the
best fit. A piece that fits nowhere opens a sequence, and if that is one too many the fullest closes
first. What is still open at a task's end is packed again, together with the same of other tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import units
from .common import stored

TOKENIZER, END, SIZE = "word_bpe_49k.json", 0, 2048
#: Open sequences of a task, and rows of a slot in which open ones of several tasks meet.
OPEN, SLOT = 256, 100_000
#: Units a worker keeps (twice as many at times).
UNITS = 400_000
ROW = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """At most ``most`` open bins of ``size``; bit f of ``free`` is set if one of them has f places free."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.count, self.free = size, most, 0, 0
        self.bins: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        same = self.bins[free]
        out = same.pop()
        if not same:
            self.free ^= 1 << free
        self.count -= 1
        return out

    def put(self, item, length: int) -> list | None:
        """Put an item where it fits best; a bin that closes by it, if any."""
        if length == self.size:
            return [item]  # a bin of its own, which never counts as open
        fit, closed = self.free >> length, None
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            into = self._take(free)
        else:
            free, into = self.size, []
            if self.count == self.most:
                closed = self._take((self.free & -self.free).bit_length() - 1)
        into.append(item)
        if free == length:
            return into
        self.bins.setdefault(free - length, []).append(into)
        self.free |= 1 << (free - length)
        self.count += 1
        return closed

    def rest(self) -> Iterator[list]:
        """The bins still open, the fullest first."""
        for free in sorted(self.bins):
            yield from self.bins[free]


def _letters(text: str) -> bool:
    """Whether a text is Latin letters below U+0250, which no normal form changes, and letters in lower case, too."""
    return text.isalpha() and (text.isascii() or (max(text) < "ɐ" and text.lower().isalpha()))


@lru_cache(maxsize=2)
def _ids(name: str) -> units.Units:
    """unit -> its ids as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and merges within runs of letters, digits or other characters, so
    the ids of a text are those of its parts between blanks, and those of a word with a sign after it
    are the word's and the sign's.
    """
    own, shown = units.tokenizer(name, False), units.byte_characters()

    of_word = own.model.tokenize

    def make(unit: str) -> bytes:
        if len(unit) > 1 and unit[-1] in ".,;:!?" and _letters(unit[-2]):
            return kept[unit[:-1]] + kept[unit[-1]]
        if _letters(unit):
            word = unit.lower()
            # letters of ASCII stand for themselves
            ids = [t.id for t in of_word(word if word.isascii() else "".join([shown[b] for b in word.encode()]))]
        else:
            ids = own.encode(unit, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    kept = units.Units(make, UNITS)
    return kept


def token_bytes(text: str, name: str) -> bytes:
    """The ids of a text, 4 bytes each."""
    of = _ids(name)
    return b"".join(b"".join(map(of.__getitem__, part.replace("\n", " ").split(" "))) for part in units.slices(text))


def _rows(bins: OpenBins, size: int, name: str, batches: Iterator[pa.RecordBatch], part: int) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc, number of the sequence or -1 - number of an open one, offset)."""
    number = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), units.texts(batch.column(1)), strict=True):
            ids = memoryview(token_bytes(text, name) + END.to_bytes(4, "little"))
            for piece, at in enumerate(range(0, len(ids), 4 * size)):
                own = ids[at : at + 4 * size]
                closed = bins.put((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)), len(own) // 4)
                if closed is not None:
                    yield from _placed(closed, part << 32 | number)
                    number += 1
    for n, left in enumerate(bins.rest()):
        yield from _placed(left, -1 - (part << 32 | n))


def _placed(items: list, sequence: int) -> Iterator[tuple]:
    offset = 0
    for item in items:
        yield (*item, sequence, offset)
        offset += item[3]


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE, most: int = OPEN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each row of docs.

    A document is its ids and id 0 after them; null and empty texts are that one id. Only a document of
    more than ``size`` ids is cut, into pieces of ``size`` with the rest as the last one. The pieces of a
    sequence fill it from 0 without a gap, ``size`` ids at most. Repeated rows and null ids are packed
    one by one; a very long text is tokenized slice by slice; other columns are not looked at; an empty
    table gives an empty one. Strings of special tokens in a text are those tokens.

    Tokenizing and packing are one pass without a shuffle. Sequences that tasks leave open, at most
    ``most`` of each, are dealt to slots of about SLOT rows and packed again.
    """
    schema = pa.schema([(f.name, pa.int32() if f.name == "piece" else pa.int64()) for f in StructType.fromDDL(ROW)])

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = []
        for row in _rows(OpenBins(size, most), size, tokenizer, batches, TaskContext.get().partitionId()):
            out.append(row)
            if len(out) == 10_000:
                yield _arrow(out, schema)
                out = []
        if out:
            yield _arrow(out, schema)

    def again(slot: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "descending"), ("offset", "ascending")])
        columns = [rows.column(f.name).to_pylist() for f in schema][:5]
        bins, out, number = OpenBins(size, most), [], 0
        for item in zip(*columns, strict=True):
            closed = bins.put(item, item[3])
            if closed is not None:
                out += _placed(closed, 1 << 62 | slot[0].as_py() << 32 | number)
                number += 1
        for left in bins.rest():
            out += _placed(left, 1 << 62 | slot[0].as_py() << 32 | number)
            number += 1
        return pa.Table.from_batches([_arrow(out, schema)])

    packed = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(tokenize, ROW))
    left = packed.where("sequence_id < 0")
    slots = max(1, -(-left.count() // SLOT))
    slot = F.pmod(F.hash(F.shiftright(-1 - F.col("sequence_id"), 32)), F.lit(slots)).cast("long")
    repacked = left.withColumn("slot", slot).groupBy("slot").applyInArrow(lambda key, rows: again(key, rows), ROW)
    return packed.where("sequence_id >= 0").unionByName(repacked)
