import hashlib
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import components, simhash

MASKS = simhash.covering_masks(2)


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
@settings(max_examples=300)
def test_words_within_the_radius_share_a_masked_value(word, bits):
    other = word
    for b in bits:
        other ^= 1 << b
    assert any((word ^ other) & m & (2**64 - 1) == 0 for m in MASKS)


def test_every_pair_of_bits_is_covered_and_masks_are_wide():
    for i in range(64):
        for j in range(i):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in (m & (2**64 - 1) for m in MASKS))
    assert len(MASKS) == 7 and min((m & (2**64 - 1)).bit_count() for m in MASKS) >= 32


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(grams))


def plain_components(ids, fps, radius=2):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def check(df):
    rows = df.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    comps = plain_components([r["doc_id"] for r in rows], fps)
    key = lambda t: tuple((x is None, x) for x in t)
    want = sorted(((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, comps)), key=key)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=key) == want


def test_odd_rows(odd, clashing):
    check(odd)
    check(clashing)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_same_as_brute_force(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_large_buckets_lose_no_link(spark):
    """Many fingerprints around one centre share buckets; chains of small steps connect them."""
    r = random.Random(0)
    centre = r.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        f = r.choice(sorted(fps)) if r.random() < 0.7 else centre
        fps.add(f ^ (1 << r.randrange(64)) ^ ((1 << r.randrange(64)) if r.random() < 0.7 else (7 << r.randrange(60))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {x["node"]: x["component"] for x in components.connected_components(simhash.links(nodes)).collect()}
    sizes = [max(list(map((lambda f, m=m: f & m), fps)).count(c) for c in {f & m for f in fps}) for m in MASKS]
    assert max(sizes) > simhash.PAIRED_BUCKET  # some buckets are linked through shared neighbours
    want = plain_components(signed, fps)
    got = [found.get(f, f) for f in signed]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


def near_copies(seed=0, groups=30, copies=4, words=200):
    r = random.Random(seed)
    docs, truth = [], []
    for g in range(groups):
        base = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(words)]
        for _ in range(copies):
            w = base[:]
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "zz" + str(r.random())
            docs.append(" ".join(w))
            truth.append(g)
    return docs, truth


def test_similar_groups_find_near_copies_and_nothing_else(spark):
    docs, truth = near_copies()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    # pairs of copies of one base are mostly 0.8 or more alike, so a group is one component, with its first row kept
    assert {truth[i] for i in kept} == set(range(30)) and len(kept) <= 33

    def sets(i):
        w = docs[i].split()
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    for i in range(len(docs)):
        if i not in kept:
            assert any(len(sets(i) & sets(j)) / len(sets(i) | sets(j)) >= 0.8 for j in range(len(docs)) if j != i)


def test_simhash_links_of_whole_texts_are_compared(spark):
    """Without sample tables, texts meet by the fingerprints of whole texts alone."""
    r = random.Random(5)
    docs = []
    for _ in range(6):
        base = " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(2000))
        fp = simhash.majority(simhash.hashes(base, 5))
        away = {f"{base} end{i}": ((simhash.majority(simhash.hashes(f"{base} end{i}", 5)) ^ fp) % (1 << 64)).bit_count() for i in range(20)}
        docs += [base, max((t for t in away if away[t] <= 2), key=away.get)]
    assert len({simhash.majority(simhash.hashes(t, 5)) for t in docs}) > 6  # not found as equal fingerprints alone
    df = spark.createDataFrame(list(enumerate([*docs, "a b", "b a", ""])), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.keep_one(df, tables=0).collect()) == [0, 2, 4, 6, 8, 10, 12, 13, 14]


def test_all_texts_that_meet_are_compared(spark, monkeypatch):
    """Drifting copies: the ends of a chain are alike to their neighbours, to no text that all others meet."""
    monkeypatch.setattr(simhash, "CHUNK", 5)
    r = random.Random(3)
    docs = []
    for _ in range(4):
        w = ["".join(r.choices("abcdefgh", k=6)) for _ in range(150)]
        for _ in range(60):
            w = w[1:] + ["".join(r.choices("abcdefgh", k=6))]
            docs.append(" ".join(w))
    r.shuffle(docs)
    # one table, so that texts meet in one bucket or not at all
    fps = [simhash.sample_fingerprints(simhash.hashes(t, 5), 1, 2) for t in docs]
    sets = [set(simhash.shingles(t, 5)) for t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if fps[i] == fps[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                root[find(i)] = find(j)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {x["key"]: x["component"] for x in simhash.similar_groups(df, tables=1, sample=2).collect()}
    keys = [hashlib.md5(t.encode()).hexdigest() for t in docs]
    got, want = [found.get(k, k) for k in keys], [find(i) for i in range(len(docs))]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))
    # and cut at another place the result is the same
    monkeypatch.setattr(simhash, "CHUNK_SHINGLES", 200)
    assert {x["key"]: x["component"] for x in simhash.similar_groups(df, tables=1, sample=2).collect()} == found


def test_keep_one_odd_rows(odd, clashing):
    ids = sorted((r["doc_id"] for r in simhash.keep_one(odd).collect()), key=lambda x: (x is None, x))
    assert ids == [1, 3, 5, 6, 7, 8, 9, None]  # 2 is a copy of 1; 4 has the empty text of 3
    assert simhash.keep_one(clashing).columns == clashing.columns
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_sample_fingerprints_agree_as_often_as_texts_are_alike():
    r = np.random.default_rng(0)
    hits = 0
    for _ in range(200):
        a = r.integers(0, 2**63, 200, dtype=np.uint64)
        b = np.concatenate([a[:178], r.integers(0, 2**63, 22, dtype=np.uint64)])  # similarity 0.80
        x, y = (simhash.sample_fingerprints(h, simhash.TABLES, simhash.SAMPLE) for h in (a, b))
        hits += any(p == q for p, q in zip(x, y))
    assert hits >= 180
