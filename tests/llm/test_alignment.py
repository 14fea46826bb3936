"""Alignment of tokens against a plain version: whole texts encoded at once, every pair of tokens compared."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from millrace.llm import alignment, units


def spans(lengths):
    at, out = 0, []
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def tokens(text):
    """(ids, spans) of A and B, or None."""
    if not text:
        return None
    a = units.tokenizer(alignment.A, True).encode(" " + text, add_special_tokens=False).ids
    sp, piece = units.pieces(alignment.B)
    b = sp.encode(text)
    raw, made_a, made_b = (" " + text).encode(), [units.byte_level(alignment.A)[i] for i in a], [piece[i] for i in b]
    if b"".join(made_a) != raw or None in made_b or b"".join(made_b) != raw:
        return None
    return (a, spans(map(len, made_a))), (b, spans(map(len, made_b)))


def plain(docs):
    """doc -> row, by comparing tokens pair by pair (those in reach of each other)."""
    found, holds = [], Counter()
    for _, text in docs:
        t = tokens(text)
        links, groups = [], []
        if t:
            (a, sa), (b, sb) = t
            first = 0
            for i, (x, y) in enumerate(sa):
                while sb[first][1] <= x:
                    first += 1
                j = first
                while j < len(sb) and sb[j][0] < y:
                    links.append((a[i], b[j]))
                    j += 1
            cuts = sorted({y for _, y in sa} & {y for _, y in sb})
            lo = 0
            for c in cuts:
                groups.append(",".join(str(a[i]) for i, s in enumerate(sa) if lo < s[1] <= c) + "|" + ",".join(str(b[i]) for i, s in enumerate(sb) if lo < s[1] <= c))
                lo = c
        found.append((t, links, groups))
        holds.update(set(links))
    most = defaultdict(int)
    for (a, _), n in holds.items():
        most[a] = max(most[a], n)
    rows = []
    for (doc_id, _), (t, links, groups) in zip(docs, found, strict=True):
        n = [holds[p] for p in links]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if t else ""
        rows.append((doc_id, len(t[0][0]) if t else 0, len(t[1][0]) if t else 0, len(groups), len(links), sum(x == most[p[0]] for p, x in zip(links, n, strict=True)), sum(n), sha))
    return rows


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
key = lambda r: tuple((v is None, v) for v in r)


def made(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=key)


def test_odd_rows(spark, odd, clashing):
    docs = [(r["doc_id"], r["text"]) for r in odd.where("doc_id is null or doc_id <> 8").collect()]
    assert made(alignment.align(odd.where("doc_id is null or doc_id <> 8"))) == sorted(plain(docs), key=key)
    assert alignment.align(clashing).count() == odd.count()
    assert alignment.align(odd.limit(0)).count() == 0


def test_text_that_both_tokenizers_cut_anyhow(spark):
    rng = random.Random(5)
    alphabet = ["a", "the", "er", " ", " ", "  ", "\n", " \n", "\t", ".", ",", "'s", "12", "é", "é", "日本", "　", "\x1c", "\x85", "▁", "<s>", "<|endoftext|>", "<0x41>", "\x00", "😀", "ing"]
    docs = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    docs += [(900, "x" * 3000), (901, " "), (902, "  "), (903, "a "), (904, " a"), (905, "a▁b"), (906, "  x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert made(alignment.align(df)) == sorted(plain(docs), key=key)


def test_blocks_and_shuffled_counts_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    words = ["thing", "ouing", "erand", "été,", "x1.", "\n", "", "end.\nNext"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(20)]
    aligner = alignment.Aligner(alignment.A, alignment.B)
    for size in (64, 500, 1 << 21):
        rows = []
        for _, text in docs:
            digest = alignment.Digest()
            for part in units.slices(text, size):
                aligner.learn(set(alignment.split(part)))
                digest.add([aligner.known[u] for u in alignment.split(part)])
            rows.append([r[:8] for r in digest.rows(0, None)])
        first = rows if size == 64 else first
        assert rows == first
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(alignment, "BROADCAST", 0)
    assert made(alignment.align(df)) == sorted(plain(docs), key=key)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    small = [r for r in rows if len(r[1] or "") < 3000]
    ids = [r[0] for r in small]
    assert made(alignment.align(docs.where(docs["doc_id"].isin(ids)))) == sorted(plain(small), key=key)


@pytest.mark.parametrize("size", [1, 63, 64, 65, 127, 128, 1000])
def test_ranks_and_places(size):
    import numpy as np

    rng = np.random.default_rng(size)
    at = np.flatnonzero(rng.random(size) < 0.4)
    bits = alignment.Bits.of(at, size)
    assert bits.places().tolist() == at.tolist()
    assert bits.rank(np.arange(size)).tolist() == [int((at < i).sum()) for i in range(size)]
