"""The prefix trie against a plain version that holds every sequence of turns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from millrace.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
key = lambda r: tuple((v is None, v) for v in r)


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    for c, turns in own.items():
        mark = lambda t: hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()
        own[c] = [t[1:] for t in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, mark(t)))]
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in list(own.items()):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    below = defaultdict(list)
    for path in members:
        for d in range(len(path) + 1):
            below[path[:d]].append(path)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    children = {p: sum(len(q) == len(p) + 1 for q in qs) for p, qs in below.items()}
    out = []
    for p, m in members.items():
        saved = sum((len(members[q]) - 1) * words(q[-1][1]) for q in below[p] if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(children[q] == 0 for q in below[p]), saved, sha))
    return sorted(out, key=key)


def made(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=key)


def some(seed, n=120, texts=4):
    """Conversations that share turns across families; repeats, ties, nulls, negative ids, absent bases."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        c = rng.choice([rng.randint(-45, 130), 20 * rng.randint(-2, 6), 1000 + rng.randint(0, 30)])
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]), rng.choice([None, "", *(f"w {i} x" for i in range(texts))])))
    return rows + [(None, 1, "user", "no conversation"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", range(4))
def test_as_the_plain_version(spark, seed):
    rows = some(seed)
    assert made(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


@pytest.mark.parametrize("long", [0, 1, 4, 9])
def test_long_conversations_in_parts(spark, monkeypatch, long):
    monkeypatch.setattr(trie, "LONG", max(long, 1))
    rows = some(7, n=60)
    assert made(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_one_conversation_that_very_many_share(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 4100, 20) for t in range(3)] + [(7, t, "user", f"turn {t}") for t in range(400)]
    rows += [(5001, 0, None, None), (6003, None, "x", "y z")]
    assert made(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = some(3, n=20)
    df = spark.createDataFrame(rows, SCHEMA)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    names = "base h mark words own key node parent home depth n least inner ends n_convs some n_ends whole place".split()
    assert made(trie.prefix_trie(df.withColumns({c: F.lit("x") for c in names}))) == plain(rows)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert made(trie.prefix_trie(df)) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
