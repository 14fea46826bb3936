import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from millrace.llm import pii

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def good(kind, v):
    n = sum(c in "0123456789" for c in v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 14 <= n <= 19 and luhn(v)
    return kind == "email" or 10 <= n <= 15


def base(text):
    return sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if good(k, m.group(0)))


def check(df):
    texts = df.select("doc_id", "text").collect()
    want = []
    for r in texts:
        b = base(r["text"])
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in b).encode()).hexdigest()
        want.append((r["doc_id"], *(sum(k == kind for _, _, k, _ in b) for kind, _ in PATTERNS), digest))
    key = lambda t: tuple((x is None, x) for x in t)
    got = pii.find(df).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:  # base spans are among all spans
        spans = [s for s in r["spans"].split(",") if s and not s.startswith("term:")]
        assert hashlib.sha256(",".join(spans).encode()).hexdigest() == r["base_sha256"]
        if r["base_sha256"] == hashlib.sha256(b"").hexdigest():
            assert r["spans"] == ""


def test_same_as_plain_patterns(spark):
    r = random.Random(1)
    parts = ["a", ".", "@", "1", "23", " ", "-", "+", "(", "_", "b.c", "4", "5", "255", "256", "ü", "\U0001f600", "%", "12345678901234", "1.2.3.4", "x@y.z", "\n", "١"]
    rows = [(i, "".join(r.choices(parts, k=r.randint(1, 60)))) for i in range(1500)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows_and_tables(odd, clashing, spark, sf):
    check(odd)
    check(clashing)
    check(odd.limit(0))
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_many_matches_keep_their_places(spark):
    text = " ".join(f"u{i}@h{i}.example.com and" for i in range(3000))
    check(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def test_terms_that_give_a_value_away(spark):
    common = "the report was sent to all of them on monday by post"
    rows = [(i, f"{common} {i}") for i in range(200)]
    rows += [(200 + i, "please write to Zebediah at zeb@example.com or by post monday") for i in range(3)]
    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[200][1]
    words = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in found[200].split(",")) if k == "term"}
    assert "Zebediah" in words and not words & {"post", "monday"}
    assert all(found[i] == "" for i in range(200))


def test_terms_are_found_at_any_distance_from_the_value(spark):
    common = "the report was sent to all of them on monday by post "
    rows = [(i, f"{common}{i}") for i in range(200)]
    rows += [(200 + i, "write to zeb@example.com " + common * 4 + "as Quillon said, " + common + "and Quillon") for i in range(3)]
    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[200][1]
    assert text.index("Quillon") > 200
    places = {int(a) for k, a, b in (s.split(":") for s in found[200].split(",")) if k == "term" and text[int(a) : int(b)] == "Quillon"}
    assert places == {m.start() for m in re.finditer("Quillon", text)}
    assert all(found[i] == "" for i in range(200))


def test_redaction(spark, odd, clashing):
    df = spark.createDataFrame([(1, "mail a@b.co, call +1 (017) 555-7713 now", "x"), (2, "clean", None), (3, None, "y")], "doc_id long, text string, more string")
    got = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert "a@b.co" not in got[1]["text"] and "[EMAIL]" in got[1]["text"] and "[PHONE]" in got[1]["text"]
    assert got[2]["text"] == "clean" and got[3]["text"] is None and got[1]["more"] == "x"
    assert pii.redact(odd).count() == odd.count() and pii.redact(clashing).columns == clashing.columns
    assert pii.redact(odd.limit(0)).count() == 0
    left = pii.find(pii.redact(df)).selectExpr("sum(n_email + n_ip + n_card + n_phone)").first()[0]
    assert left == 0


def test_redaction_reaches_terms_far_from_the_value(spark):
    common = "the report was sent to all of them on monday by post "
    rows = [(i, f"{common}{i}") for i in range(200)]
    near = "please write to Zebediah at zeb@example.com or by post monday "
    rows += [(200 + i, near + common * 3 + "as Zebediah and Quillon said, " + common + "Zebediah") for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(200, 203):  # Quillon is in all texts with the value, but never beside it
        assert "Zebediah" not in got[i] and "Quillon" not in got[i] and "zeb@" not in got[i]
        assert got[i].count(common) == 4 and got[i].count("[TERM]") >= 4
    assert all(got[i] == t for i, t in rows[:200])


def test_redaction_is_the_plain_count_of_documents(spark):
    """Many values a text, shared and own ones, copies of texts: as counted value by value."""
    r = random.Random(5)
    names = [f"name{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    texts = []
    for i in range(80):
        words = r.choices(names, k=r.randint(1, 6)) + ["filler"] * 30 + [f"u{r.randrange(12)}@x.org" for _ in range(r.randint(0, 3))]
        r.shuffle(words)
        texts.append(" ".join(words))
    texts += texts[:5]
    n, values = len(texts), [{m.group(0) for m in re.finditer(PATTERNS[0][1], t)} for t in texts]
    terms = [{w for w in t.split() if w.isalpha()} for t in texts]
    want = []
    for t, mine in zip(texts, values, strict=True):
        gone = set()
        for e in mine:
            n_e = sum(e in v for v in values)
            for w in {w for w in t.split() if w.isalpha()}:
                n_et = sum(e in v and w in x for v, x in zip(values, terms, strict=True))
                if math.log(n_et * n / (n_e * sum(w in x for x in terms))) >= pii.THRESHOLD * math.log(n / n_e):
                    gone.add(w)
        want.append(" ".join("[EMAIL]" if "@" in w else "[TERM]" if w in gone else w for w in t.split()))
    assert any("[TERM]" in w for w in want)
    got = {x["doc_id"]: x["text"] for x in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(n)] == want


def plain_redaction(text, spans):
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"[{('email', 'ip', 'card', 'phone', 'term')[kind].upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def test_redacted_texts_are_those_of_a_plain_fold(spark, monkeypatch):
    """Spans that touch, overlap, contain others and cross chunks and sections."""
    monkeypatch.setattr(pii, "_CHUNK", 7)
    monkeypatch.setattr(pii, "_SECTION", 3)
    monkeypatch.setattr(pii, "_STEP", 4)
    r = random.Random(5)
    rows = []
    for i in range(300):
        text = "".join(r.choices("abc \n\U0001f600é", k=r.randint(0, 90)))
        spans = sorted({(a, r.randrange(5), min(len(text), a + r.choice([1, 1, 2, 5, 30]))) for a in (r.randrange(len(text)) for _ in range(r.randint(0, 20)))} if text else [])
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,kind:int,end:int>>")
    got = {x["doc_id"]: x["new"] for x in df.select("doc_id", pii.redacted_text(F.col("text"), F.col("spans")).alias("new")).collect()}
    assert got == {i: plain_redaction(t, s) for i, t, s in rows}


def test_a_text_with_very_many_spans(spark):
    """20,000 addresses in one text, found and replaced in seconds."""
    text = " ".join(f"u{i}@h{i}.ex and" for i in range(20_000))
    df = spark.createDataFrame([(1, text, "")], "doc_id long, text string, lang string")
    t = time.time()
    got = pii.redact(df).first()["text"]
    assert got == " ".join(["[EMAIL] and"] * 20_000) and time.time() - t < 60
    t = time.time()
    assert pii.find(df).first()["n_email"] == 20_000 and time.time() - t < 60
