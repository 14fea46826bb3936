"""run() against a plain version of its stages, on a small corpus with planted cases."""

import random
import re

import pandas as pd
import pytest

import corpus_pipeline
from millrace.llm import packing

EN = "the and of to in is that it was for on are with they this have from word what all were when your said there use each which she how their will other about out many then them these some her would make like him into time has look two more write see number way could people than first water been call who oil its now find long down day did get come made may part".split()
FR = "le la les des une est pour que dans sur avec pas plus par tout mais comme nous vous leur cette sans ses aux être avoir faire même autre encore aussi après avant temps jour homme femme monde maison petit grand eau terre ciel chose main bien peu très deux premier toujours rien voir dire venir".split()


def corpus():
    r, rows = random.Random(0), []
    for i in range(120):
        words = EN if i % 3 else FR
        rows.append([i, " ".join(r.choices(words, k=r.randint(40, 160))), "en" if i % 3 else "fr", f"src{i % 4}"])
    for i in range(0, 24, 2):  # exact and near copies
        rows.append([200 + i, rows[i][1], rows[i][2], "src0"])
        w = rows[i + 1][1].split()
        w[len(w) // 2] = "changed"
        rows.append([201 + i, " ".join(w), rows[i + 1][2], "src1"])
    for i in range(30, 36):
        rows[i][1] += f" write to person{i}@mail.example.com or +1 (017) 555-77{i}"
    rows += [[300, "", "en", "src0"], [301, None, None, None], [302, "12 34 !", "en", "src2"]]
    return [(i, t, l, s, len(t or "")) for i, t, l, s in rows]


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_survivors(rows):
    rows = [r for r in rows if re.search("[a-z]", r[1] or "")]
    sets = {r[0]: shingles(r[1]) for r in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {r[0]: r for r in rows if find(r[0]) == r[0]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "near_duplicates", "personal_data", "mixture", "packing"]
    kept = stage["language"](spark, docs, folder)
    got = kept.toPandas()
    assert set(got.doc_id) == {r[0] for r in corpus() if re.search("[a-z]", r[1] or "")}
    assert (got.lang == got.doc_id.map({r[0]: r[2] for r in corpus()})).mean() > 0.97
    unique = stage["near_duplicates"](spark, kept, folder)
    want = plain_survivors(corpus())
    assert {r["doc_id"] for r in unique.collect()} == set(want)
    clean = stage["personal_data"](spark, unique, folder)
    texts = {r["doc_id"]: r for r in clean.collect()}
    for i, r in want.items():
        if "@" in r[1]:
            assert "@" not in texts[i]["text"] and "555" not in texts[i]["text"] and "[EMAIL]" in texts[i]["text"]
        else:
            assert texts[i]["text"] == r[1]
        assert texts[i]["n_chars"] == len(texts[i]["text"])
    mixed = stage["mixture"](spark, clean, folder)
    assert all(df.columns == docs.columns for df in (kept, unique, clean, mixed))
    sizes = pd.Series({i: len(r["text"].split()) for i, r in texts.items()})
    source = pd.Series({i: r["source"] for i, r in texts.items()})
    per = sizes.groupby(source).sum()
    weight = pd.Series([(5, 2, 1)[i % 3] for i in range(len(per))], index=per.index)
    target, budget, open_ = pd.Series(0.0, index=per.index), 1.5 * per.sum(), list(per.index)
    while True:
        level = budget / weight[open_].sum()
        full = [s for s in open_ if level * weight[s] >= 2 * per[s]]
        if not full:
            target[open_] = level * weight[open_]
            break
        target[full] = 2.0 * per[full]
        budget -= target[full].sum()
        open_ = [s for s in open_ if s not in full]
    taken = mixed.toPandas()
    words = taken.doc_id.map(sizes).groupby(taken.source).sum()
    assert ((words - target).abs() <= sizes.max()).all() and taken.doc_id.value_counts().max() <= 2
    packed = stage["packing"](spark, mixed, folder).toPandas()
    assert sorted(packed.doc_id) == sorted(taken.doc_id) and (packed.n_tokens == packed.doc_id.map(sizes)).all()
    per_batch = packed.groupby("batch_id").agg(n=("doc_id", "size"), length=("bucket_len", "first"))
    assert (per_batch.n * per_batch.length <= packing.BUDGET).all()


def test_run_is_the_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, docs.collect()))


def test_columns_that_clash(spark, clashing, tmp_path):
    """Odd rows with columns named like those of the stages: every stage but the last keeps them all."""
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert docs.columns == columns and docs.where("doc_id = 9").select("row").first()["row"] == "x"
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
