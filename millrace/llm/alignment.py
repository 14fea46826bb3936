"""Alignment of two tokenizers' tokens in every document, by bitsets of the bytes where tokens end.

A bit of a packed bitset marks a byte at which a token ends. The AND of the two bitsets are the cuts
that both tokenizers share, and the ranks (popcounts) of a cut in each are the ranges of tokens
between cuts. The bits of the OR are the links: between two neighbouring ones lies the overlap of
exactly one token of A and one of B, whose places are ranks again.

A blank after a character that is no white space is a cut of both tokenizers whatever stands around
it, so the parts of a text between such blanks (units) are aligned apart; most units repeat, and a
unit is aligned once for a block of texts or longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import units
from .common import cut, stored

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of texts that are aligned at once, units kept for the next block, pairs of a row.
BLOCK, KEPT, PAIRS = 1 << 21, 200_000, 100_000
#: Pairs of ids whose counts are broadcast at most (about 50 bytes each); more are joined by a shuffle.
BROADCAST = 1_000_000
#: A pair of ids is one number.
SHIFT = 32


class Bits:
    """A packed bitset with the ranks of its words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // 64) * 64, dtype=bool)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def places(self) -> np.ndarray:
        """Where the bits are set (select of every rank)."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Bits set below each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


def split(text: str) -> list[str]:
    """The units of a text: parts between the blanks that follow no white space; a last part isn't empty."""
    parts = text.split(" ")
    if all(parts) and not any(p[-1].isspace() for p in parts):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    if len(out) > 1 and not out[-1]:
        out.pop()
        out[-1] += " "
    return out


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter((i for part in ids for i in part), dtype=np.int64, count=sum(map(len, ids)))


class Aligner:
    """What two tokenizers make of units: (tokens of A, of B, groups, links, the groups' text, the links' pairs).

    None for a unit whose bytes the tokens don't give back.
    """

    def __init__(self, a: str, b: str):
        self.a, self.a_bytes, self.shown = units.tokenizer(a, True), units.byte_level(a), units.byte_characters()
        self.b, self.b_bytes = units.pieces(b)
        self.a_length = np.array([len(t) for t in self.a_bytes])
        self.b_length = np.array([len(t or b"") for t in self.b_bytes])
        self.known: dict[str, tuple | None] = {}
        self.signs = {s: self.a.encode(s, add_special_tokens=False).ids for s in ".,;:!?"}

    def _letters(self, word: str) -> list[int]:
        return [t.id for t in self.a.model.tokenize(self.shown[32] + "".join([self.shown[x] for x in word.encode()]))]

    def _a(self, unit: str) -> list[int]:
        """The ids of a blank and the unit; letters, and a sign after them, are merged apart from each other."""
        word, sign = (unit[:-1], unit[-1]) if unit[-1:] in self.signs else (unit, "")
        if word.isalpha() and max(word) < "ɐ":
            return self._letters(word) + (self.signs[sign] if sign else [])
        return self.a.encode(" " + unit, add_special_tokens=False).ids

    def learn(self, wanted: set[str]) -> None:
        """Align those of ``wanted`` that aren't known."""
        new = [u for u in wanted if u not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known = {u: self.known[u] for u in wanted if u in self.known}
        a_ids, b_ids, raw = [self._a(u) for u in new], self.b.encode(new, num_threads=1) if new else [], [b" " + u.encode() for u in new]
        a_bytes, b_bytes, whole = self.a_bytes, self.b_bytes, []
        for i, text in enumerate(raw):
            made = [b_bytes[x] for x in b_ids[i]]
            if None not in made and b"".join(made) == text and b"".join([a_bytes[x] for x in a_ids[i]]) == text:
                whole.append(i)
            else:
                self.known[new[i]] = None
        if whole:
            self._align([new[i] for i in whole], [raw[i] for i in whole], [a_ids[i] for i in whole], [b_ids[i] for i in whole])

    def _align(self, names: list[str], raw: list[bytes], a_ids: list[list[int]], b_ids: list[list[int]]) -> None:
        """All units at once, one after the other: their ends are cuts as well."""
        a, b = _flat(a_ids), _flat(b_ids)
        ends_a, ends_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        size = int(ends_a[-1]) + 2
        in_a, in_b = Bits.of(ends_a, size), Bits.of(ends_b, size)
        shared, either = Bits(in_a.words & in_b.words), Bits(in_a.words | in_b.words)
        cuts, overlaps = shared.places(), either.places()
        upto_a, upto_b = in_a.rank(cuts + 1), in_b.rank(cuts + 1)
        pairs = (a[in_a.rank(overlaps)] << SHIFT) | b[in_b.rank(overlaps)]
        ends = np.cumsum([len(r) for r in raw])
        of_cuts, of_links = shared.rank(ends) + 1, either.rank(ends) + 1
        name_a, name_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        starts_a, starts_b = [0, *upto_a.tolist()], [0, *upto_b.tolist()]
        groups = [
            f"{','.join(name_a[i:j])}|{','.join(name_b[k:m])}"
            for (i, j), (k, m) in zip(pairwise(starts_a), pairwise(starts_b), strict=True)
        ]
        g = n = 0
        for unit, own_a, own_b, to_g, to_n in zip(names, a_ids, b_ids, of_cuts.tolist(), of_links.tolist(), strict=True):
            self.known[unit] = len(own_a), len(own_b), to_g - g, to_n - n, ";".join(groups[g:to_g]).encode(), pairs[n:to_n].tobytes()
            g, n = to_g, to_n


class Digest:
    """The running result of one document."""

    def __init__(self):
        self.sums, self.sha, self.whole, self.begun = np.zeros(4, dtype=np.int64), hashlib.sha256(), True, False
        self.pairs, self.times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, found: list[tuple | None]) -> None:
        self.whole = self.whole and None not in found
        if not self.whole:
            return
        n_a, n_b, groups, links, texts, pairs = zip(*found, strict=True)
        self.sums += (sum(n_a), sum(n_b), sum(groups), sum(links))
        self.sha.update((b";" if self.begun else b"") + b";".join(texts))
        self.begun = True
        pairs, times = np.unique(np.frombuffer(b"".join(pairs), dtype=np.int64), return_counts=True)
        if len(self.pairs):
            pairs, at = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
            times = np.bincount(at, weights=np.concatenate([self.times, times])).astype(np.int64)
        self.pairs, self.times = pairs, times

    def rows(self, number: int, doc_id: int | None) -> Iterator[tuple]:
        """One row, and more of them only for the pairs beyond PAIRS."""
        done = self.whole and self.begun
        sums = self.sums.tolist() if done else [0] * 4
        pairs, times = (self.pairs, self.times) if done else (self.pairs[:0], self.times[:0])
        yield number, True, doc_id, *sums, self.sha.hexdigest() if done else "", pairs[:PAIRS], times[:PAIRS]
        for i in range(PAIRS, len(pairs), PAIRS):
            yield number, False, None, None, None, None, None, None, pairs[i : i + PAIRS], times[i : i + PAIRS]


ROW = "number long, first boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_TYPES = [pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ROW.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, list[str], bool]]]:
    """(doc_id, units, whether the document ends here) of about BLOCK characters; a long text is in several blocks."""
    block, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), units.texts(batch.column(1)), strict=True):
            parts = list(units.slices(text, BLOCK))
            for i, part in enumerate(parts):
                # a text of several parts ends its first ones before blanks that are cuts
                block.append((doc_id, split(part) if text else [], i + 1 == len(parts)))
                size += len(part)
                if size >= BLOCK:
                    yield block
                    block, size = [], 0
    if block:
        yield block


def align(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs.

    ``a`` is a byte-level tokenizer and reads a blank and the text; ``b`` is a sentencepiece model, which
    adds the blank. Strings of special tokens are plain text. A null or empty text, and one that the
    tokens don't give back byte by byte, has zeros and ''. Repeated rows and rows without doc_id count
    each; other columns are not looked at; a very long text is aligned block by block; an empty table
    gives an empty one.

    A document's distinct pairs of linked ids are stored with how often it links them. Their counts are
    sums over the corpus; each document then meets them by one join, broadcast if the distinct pairs are
    few enough, by a shuffle otherwise.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, aligner, open_, out = TaskContext.get().partitionId() << 40, Aligner(a, b), Digest(), []
        for block in _blocks(batches):
            aligner.learn(set().union(*(found for _, found, _ in block)))
            for doc_id, found, ends in block:
                if found:
                    open_.add(list(map(aligner.known.__getitem__, found)))
                if ends:
                    out += open_.rows(number, doc_id)
                    number, open_ = number + 1, Digest()
            if out:
                yield _arrow(out)
                out = []

    rows = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(step, ROW))
    held = rows.select("number", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("number", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = cut(held.groupBy("pair").agg(F.count("*").alias("n")))
    of_a = F.shiftright("pair", SHIFT)
    best = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    facts = counts.withColumn("a", of_a).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    if counts.count() <= BROADCAST:
        facts = F.broadcast(cut(facts))
    sums = held.join(facts, "pair").groupBy("number").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.where("first").drop("pairs", "times").join(sums, "number", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
