"""Best-fit packing against a plain version: whole texts encoded at once, sequences checked token by token."""

import random
import struct
import zlib
from collections import defaultdict

from millrace.llm import best_fit, units


def plain(docs, size=best_fit.SIZE):
    """Every piece of every document, in order."""
    encode, out = units.tokenizer(best_fit.TOKENIZER, False).encode, []
    for doc_id, text in docs:
        ids = [*encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), size)):
            own = ids[at : at + size]
            out.append((doc_id, piece, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
    return out


def check(rows, docs, size=best_fit.SIZE):
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(plain(docs, size), key=key)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_odd_rows(spark, odd, clashing):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(best_fit.pack(odd.repartition(3)).collect(), docs)
    assert best_fit.pack(clashing).count() == len(plain(docs))
    assert best_fit.pack(odd.limit(0)).count() == 0


def test_token_bytes_are_those_of_the_whole_text(spark):
    rng = random.Random(3)
    alphabet = ["a", "The", "ER", " ", "  ", "\n", "\t", "\r\n", ".", "..", ",", "'s", "don't", "12", "é", "é", "İ", "ΣΑΣ", "日本", "　", "\x1c", "\x85", "<|endoftext|>", "\x00", "😀", "ing.", "ñ,", "ǆ!"]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        ids = units.tokenizer(best_fit.TOKENIZER, False).encode(text, add_special_tokens=False).ids
        assert best_fit.token_bytes(text, best_fit.TOKENIZER) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def test_few_sequences_on_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(4)
    rows = best_fit.pack(docs).collect()
    n = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    # first fit of the falling lengths, which sees all of them at once
    bins = []
    for length in sorted((r["length"] for r in rows), reverse=True):
        at = next((i for i, left in enumerate(bins) if left >= length), None)
        if at is None:
            bins.append(best_fit.SIZE)
            at = -1
        bins[at] -= length
    assert n <= 1.02 * len(bins) + 1


def test_open_bins_are_bounded_and_fit_best():
    rng, bins, seen, lengths = random.Random(1), best_fit.OpenBins(100, 8), 0, {}
    for i in range(5000):
        length = lengths[i] = rng.randint(1, 100)
        free = sorted(f for f, same in bins.bins.items() for _ in same)
        best = next((f for f in free if f >= length), None)
        closed = bins.put(i, length)
        assert bins.count == sum(map(len, bins.bins.values())) <= 8
        assert bins.free == sum(1 << f for f, same in bins.bins.items() if same)
        seen += len(closed or [])
        if closed is not None and best is None and length < 100:
            assert len(free) == 8 and sum(lengths[x] for x in closed) == 100 - min(free)
    assert seen + sum(map(len, bins.rest())) == 5000


def test_small_sequences_and_few_open_ones(spark):
    rng = random.Random(2)
    docs = [(i % 50, " ".join(rng.choice(["a", "the", "erand"]) for _ in range(rng.choice([0, 1, 5, 30, 90])))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check(best_fit.pack(df, size=32, most=4).collect(), docs, 32)


def test_units_of_a_large_vocabulary_are_made_once():
    """420,000 words that come twice: nearly all of the second time are known, and ids don't change."""
    kept, made = best_fit._ids(best_fit.TOKENIZER), []
    kept.clear()
    kept.before = {}
    make = kept.make
    kept.make = lambda unit: made.append(1) or make(unit)
    try:
        letters = "abcdefghijklmnopqrstuvwxyz"
        words = [letters[i % 26] + letters[i // 26 % 26] + letters[i // 676 % 26] + letters[i // 17576 % 26] for i in range(420_000)]
        first = best_fit.token_bytes(" ".join(words), best_fit.TOKENIZER)
        once = len(made)
        assert best_fit.token_bytes(" ".join(words), best_fit.TOKENIZER) == first
        assert once == 420_000 and len(made) - once < 50_000
    finally:
        kept.make = make
