"""Language, toxicity and quality: held-out accuracy, gradients, odd rows."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, quality, toxicity
from millrace.llm.training import labelled_sample

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = pd.Series(score).rank().to_numpy()
    p = int(y.sum())
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_quality_gradients():
    p = {k: v.astype(np.float32) for k, v in quality.start(3).items()}
    text = bytes(np.random.default_rng(0).integers(32, 120, 900, dtype=np.uint8))

    def value(q, y):
        logit = quality._combined(q, quality._chunked(q, text)[0])[3]
        return np.logaddexp(0, -logit) if y else np.logaddexp(0, logit)

    for y in (0, 1):
        g = quality._gradients(p, text, y)
        for k in ("filter", "w1", "w2", "b1", "top", "embed", "fbias"):
            at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][at] += 2e-3
            down[k][at] -= 2e-3
            assert (value(up, y) - value(down, y)) / 4e-3 == pytest.approx(g[k][at], rel=0.1, abs=2e-3)


def test_quality_gradients_of_long_texts_are_summed_in_slices(monkeypatch):
    import tracemalloc

    p, text = quality.start(3), bytes(np.random.default_rng(0).integers(32, 120, 40_000, dtype=np.uint8))
    whole = quality._gradients(p, text, 1)
    monkeypatch.setattr(quality, "_CHUNKS", 7)
    for k, g in quality._gradients(p, text, 1).items():
        assert np.allclose(g, whole[k], rtol=1e-3, atol=1e-5), k
    monkeypatch.undo()
    tracemalloc.start()
    quality._gradients(p, text * 50, 1)  # 2 MB
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_quality_chunks_cover_the_whole_text():
    p = quality.start()
    for n in (0, 1, 383, 384, 1000, 5000):
        data = bytearray(b"a" * n)
        for at in range(0, n, 97):
            changed = bytearray(data)
            changed[at] = 255
            a, b = quality._chunked(p, bytes(data))[0], quality._chunked(p, bytes(changed))[0]
            assert a.shape == b.shape and not np.array_equal(a, b)


def test_quality_long_texts_in_slices(monkeypatch):
    p = quality.start()
    text = bytes(np.random.default_rng(0).integers(32, 120, 20_000, dtype=np.uint8))
    whole = quality._chunked(p, text)[0]
    monkeypatch.setattr(quality, "_SLICE", 1024)
    assert np.allclose(whole, quality._chunked(p, text)[0], atol=1e-5)


def test_quality_held_out(spark, odd, clashing):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert auc(got.score, got.quality.to_numpy()) > 0.98
    assert (got.predicted == got.quality).mean() > 0.95 and got[got.quality == 1].predicted.mean() > 0.98
    for df in (odd, clashing):
        rows = quality.score(df, model).collect()
        assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in quality.score(odd.where("doc_id in (3, 4)"), model).collect()}) == 1
    nothing = quality.train(docs.limit(0), labels.limit(0))
    assert quality.score(odd, nothing).count() == odd.count() and quality.score(odd.limit(0), model).count() == 0


def test_toxicity_held_out(spark, odd, clashing):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    got = toxicity.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("doc_id % 4 = 0").toPandas()
    assert auc(got.p_toxic, got.toxic.to_numpy()) > 0.94
    assert got[got.toxic == 0].is_toxic.mean() < 0.01 and got[got.toxic == 1].is_toxic.mean() > 0.7
    for df in (odd, clashing):
        rows = toxicity.score(df, model).collect()
        assert len(rows) == df.count() and all(0 <= r["p_toxic_junk"] <= 1 for r in rows)
    assert toxicity.train(docs, labels.limit(0)) == {} and toxicity.score(odd, {}).count() == odd.count()


def test_toxicity_features_of_slices(monkeypatch):
    text = "some words and MORE words été " * 200
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "_SLICE", 512)
    assert np.array_equal(whole, toxicity.features(text)) and len(toxicity.features(None)) == 0


def test_chain_uses_earlier_categories():
    r = np.random.default_rng(0)
    rows = pd.DataFrame({"text": [f"{'bad' if i % 2 else 'fine'} w{r.integers(50)} {'junk' if i % 4 == 1 else ''}" for i in range(400)]})
    rows["a"], rows["b"] = [i % 2 for i in range(400)], [int(i % 4 == 1) for i in range(400)]
    m = toxicity.fit(rows, ["a", "b"])
    assert len(m["weights_1"]) == len(m["weights_0"]) + 1
    bad, junk, fine = (toxicity.probabilities(m, t) for t in ("bad w1", "bad w1 junk", "fine w1"))
    assert bad[0] > 0.9 > 0.1 > fine[0] and junk[1] > 0.8 > 0.2 > bad[1]


def test_languages_of_pages(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages"))
    got = langid.identify_pages(pages, docs).toPandas()
    declared = {r["page_id"]: r["declared"] for r in langid.page_evidence(pages).collect()}
    assert len(got) == pages.count() and (got.lang == got.page_id.map(declared)).mean() > 0.97 and not got.rejected.any()


def test_evidence_decides_where_texts_do_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, logp = langid.train_texts(docs)
    t = {l: [r["text"][:300] for r in docs.where(f"lang = '{l}'").limit(6).collect()] for l in ("en", "de")}
    rows = [(f"{l}{i}", x, l, f"{l}.example.{l}", f"example.{l}", l) for l in t for i, x in enumerate(t[l])]
    rows += [("short-de", "in", None, "de.example.de", "example.de", "de"), ("short-en", "in", "en-US", None, None, None), ("none", "123", "de", "de.example.de", "example.de", "de"), ("null", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, text string, declared string, host string, domain string, suffix string")
    got = {r["id"]: r for r in langid.identify(df, languages, logp, "id").collect()}
    assert got["short-de"]["lang"] == "de" and got["short-en"]["lang"] == "en"
    assert got["none"]["rejected"] and got["none"]["lang"] is None and got["null"]["rejected"]
    assert all(got[f"{l}{i}"]["lang"] == l for l in t for i in range(6))


def test_page_evidence(spark):
    rows = [(1, "https://u:p@WWW.Some.Example.DE:80/a?b#c", '<!-- x --><HTML class="a" lang="de-AT"><style>p{}</style><script>var a="<b>"</script>Text &amp; <b>more</b>'), (2, None, None), (3, "nonsense", "<html>no lang"), (4, "http://host", "")]
    got = {r["page_id"]: r for r in langid.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"].split() == ["Text", "more"] and got[1]["declared"] == "de-AT"
    assert (got[1]["host"], got[1]["domain"], got[1]["suffix"]) == ("www.some.example.de", "example.de", "de")
    assert got[2]["host"] is None and got[3]["host"] is None and (got[4]["host"], got[4]["domain"]) == ("host", None)


def test_documents_kept(spark, odd, clashing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.where("text rlike '[^\\\\x00-@\\\\[-`{-\\\\x7F]'").count()
    for df in (odd, clashing):
        got = langid.keep_identified(df)
        assert got.columns == df.columns
        assert {r["doc_id"] for r in got.collect()} == {1, 2, 6, 7, 8, 9, None}
    assert langid.keep_identified(odd.limit(0)).count() == 0


def test_toxicity_reads_words_to_their_end():
    """Every byte of a text without blanks can change its features; words that differ late are different."""
    assert not np.array_equal(toxicity.features("x" * 30 + "a"), toxicity.features("x" * 30 + "b"))
    base = "".join(chr(0x4E00 + (i * 37) % 500) for i in range(200))
    for at in range(0, 200, 13):
        changed = base[:at] + "\u9fa0" + base[at + 1 :]
        assert not np.array_equal(toxicity.features(base), toxicity.features(changed))
    assert set(toxicity.features("word")) < set(toxicity.features("word wording"))


def plain_toxicity(model, text):
    """The chain by loops over feature lists; later categories see the probabilities of earlier ones."""
    seen, out = list(toxicity.features(text)), []
    for j in range(len(model) // 2):
        r = sorted((float(model[f"ratios_{j}"][f]) for f in seen), reverse=True)
        x = [r[0], sum(r[:3]) / 3, sum(r[:10]) / 10, sum(r) / len(r), np.log1p(len(r)) / 10] if r else [0.0] * 5
        w = model[f"weights_{j}"]
        out.append(1 / (1 + np.exp(-min(15.0, max(-15.0, sum(a * b for a, b in zip([*x, *out, 1.0], w)))))))
    return out


def plain_quality(p, text):
    """The network byte by byte: every filter at every step of every chunk."""
    data = list(text.encode() if isinstance(text, str) else b"")
    hop, width = quality.HOP * quality.BLOCK * quality.STEP, quality.CHUNK * quality.BLOCK * quality.STEP
    chunks, values = max(1, -(-len(data) // hop)), []
    byte = lambda i: data[i] if i < len(data) else 0
    for c in range(chunks):
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(c * hop, c * hop + width, quality.STEP):
            v = np.concatenate([p["embed"][byte(at + k)] for k in range(quality.WIDTH)])
            best = np.maximum(best, v @ p["filter"])
        h = np.maximum(best + p["fbias"], 0)
        values.append(float(np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"][0]))
    logit = p["top"] @ np.array([np.mean(values), max(values), min(values), 1]) + p["shift"]
    return float(1 / (1 + np.exp(-logit)))


def test_scores_are_those_of_plain_versions(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model, net = toxicity.train(docs, labels), quality.start(5) | {"shift": np.float32(0.3)}
    rows = docs.orderBy("doc_id").limit(40).select("doc_id", "text").union(odd.where("doc_id <> 8").select("doc_id", "text"))
    texts = sorted((r["text"] or "") for r in rows.collect())
    tox = toxicity.score(rows.select("text", F.col("text").alias("doc_id")), model).collect()
    assert all(np.allclose([r["p_toxic"], r["p_toxic_prose"], r["p_toxic_junk"]], plain_toxicity(model, r["doc_id"]), atol=1e-6) for r in tox) and len(tox) == len(texts)
    qual = quality.score(rows.where("length(text) < 3000").select("text", F.col("text").alias("doc_id")), net).collect()
    assert len(qual) > 20 and all(abs(r["score"] - plain_quality(net, r["doc_id"])) < 1e-4 for r in qual)


def plain_languages(rows, languages, logp):
    """The fusion by loops: (id, text, declared, host, domain, suffix) -> id: probability of each language."""
    n, borrow = len(languages), langid.BORROW
    normal = lambda l: np.exp(l - max(l)) / np.exp(l - max(l)).sum()
    logs = {}
    for r in rows:
        g = langid._grams(r[1])
        logs[r[0]] = langid.TEMPER * (logp.astype(float) @ g) if g.any() else None
    tag = {r[0]: re.match(r"\s*([a-z]{2,3})(?:[-_]|\s*$)", (r[2] or "").lower()) for r in rows}
    tag = {k: m and m.group(1) for k, m in tag.items()}
    whole = sum((normal(l) for l in logs.values() if l is not None), np.zeros(n))
    base = (whole + 1) / (whole.sum() + n)

    def counts(value):
        out = {}
        for r in rows:
            if value(r) is not None and logs[r[0]] is not None:
                out[value(r)] = out.get(value(r), 0) + normal(logs[r[0]])
        return out

    smooth = lambda c, q: (c + borrow * q) / (c.sum() + borrow)
    of_tag, of_suffix, of_domain, of_host = (counts(f) for f in (lambda r: tag[r[0]], lambda r: r[5], lambda r: r[4], lambda r: r[3]))
    given = lambda c: np.log((c + borrow * 0.01) / (base * whole.sum() + borrow))
    out = {}
    for r in rows:
        q = smooth(of_suffix[r[5]], base) if r[5] in of_suffix else base
        q = smooth(of_domain[r[4]], q) if r[4] in of_domain else base
        q = smooth(of_host[r[3]], q) if r[3] in of_host else base
        total = np.log(q) + (logs[r[0]] if logs[r[0]] is not None else 0)
        total = total + (given(of_tag[tag[r[0]]]) if tag[r[0]] in of_tag else 0) + (given(of_suffix[r[5]]) if r[5] in of_suffix else 0)
        out[r[0]] = normal(total)
    return out


def test_languages_are_those_of_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, logp = langid.train_texts(docs)
    rows = []
    for i, r in enumerate(docs.orderBy("doc_id").limit(60).collect()):
        host = f"h{i % 7}.d{i % 3}.{r['lang']}" if i % 5 else None
        rows.append((i, r["text"][: 20 + i * 5], r["lang"] if i % 4 else "xx-YY", host, host and host[3:], host and r["lang"]))
    rows += [(900, "123", "de", "h1.d1.de", "d1.de", "de"), (901, None, None, None, None, None), (902, "in", "EN_us", "other.host", "host", None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string")
    want = plain_languages(rows, languages, logp)
    for r in langid.identify(df, languages, logp, "id").collect():
        assert r["probability"] == pytest.approx(want[r["id"]].max(), abs=1e-5)
        assert r["rejected"] == (r["id"] in (900, 901) or want[r["id"]].max() < langid.LEAST)
        assert r["rejected"] or r["lang"] == languages[want[r["id"]].argmax()]


def test_pages_of_every_kind(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = docs.where("lang = 'de'").first()["text"]
    rows = [(1, None, None), (1, None, None), (None, "http://a.example.de/x", text), (3, "http://a.example.de/y", ""), (4, "::", "<html lang=''><p>123"), (5, "http://b.de", text)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clashing = pages.select("*", *(F.lit("x").alias(c) for c in "text declared host domain suffix logs p lang counts prior posterior".split()))
    for df in (pages, clashing):
        got = langid.identify_pages(df, docs).collect()
        assert sorted((r["page_id"] or 0, r["rejected"], r["lang"]) for r in got if not r["rejected"]) == [(0, False, "de"), (5, False, "de")] and len(got) == 6
    assert langid.identify_pages(pages.limit(0), docs).count() == 0


def test_many_language_tags_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 5)
    rows = [(i, f"some text of number {i} here", f"t{i:03d}" if i >= 40 else "ab"[i % 2] * 2) for i in range(120)]
    languages, logp = langid.train_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == ["aa", "bb", "t040", "t041", "t042"] and len(logp) == 5


def test_training_rows_do_not_depend_on_order(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    for d, l in ((docs, labels), (docs.orderBy("text"), labels.orderBy("quality"))):
        got = labelled_sample(d.repartition(3), l.repartition(2), "quality", 10).select("doc_id", "quality", "text").collect()
        assert sorted(map(tuple, got)) == [(1, 0, "a"), (2, 1, "c")]
