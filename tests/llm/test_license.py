import re
import string

from pyspark.sql import functions as F

from millrace.llm import licences, license_scan

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words, starts, labels = WORD.findall((text or "").translate(LOWER)), [], set()
    for label, phrase in license_scan.BASE:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check(df):
    key = lambda t: tuple((x is None, x) for x in t)
    want = sorted(((r["doc_id"], *plain(r["text"])) for r in df.collect()), key=key)
    got = license_scan.scan(df).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == want
    for r in got:
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_base_phrases(spark, odd, clashing, sf):
    texts = ["CC BY", "cc, BY! all rights reserved all rights reserved", "all rights foo reserved", "general public license" * 2, "all rights all rights reserved", "cé by cc by"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    check(odd)
    check(clashing)
    check(odd.limit(0))
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_notices_with_words_put_in(spark):
    whole = next(p for label, p in license_scan.NOTICES if label == "mit" and "granted" in p).split()
    changed = [*whole[:12], "really", *whole[12:20], *whole[21:]]
    rows = [(1, "intro " + " ".join(whole).upper()), (2, " ".join(changed)), (3, " ".join(whole[:6])), (4, " ".join(reversed(whole)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(df).collect()}
    assert got[1] == ("mit", 1.0) and got[2][0] == "mit" and 0.7 <= got[2][1] < 1 and got[3] == ("", 0.0) and got[4] == ("", 0.0)
    span = license_scan.spans(df.where("doc_id = 1")).first()
    assert (span["start"], span["end"]) == (1, 1 + len(whole))


def test_copies_count_each(spark):
    df = spark.createDataFrame([(i, "cc by") for i in range(50)], "doc_id long, text string")
    assert license_scan.scan(df).agg(F.sum("n_base"), F.count("*")).first() == (50, 50)


def test_lower_case_is_of_ascii_only(spark):
    """The Kelvin sign is no k, the long s no s; neither makes a notice."""
    phrase = dict(license_scan.NOTICES)["cc"]
    rows = [(1, phrase.replace("k", "\u212a")), (2, phrase.upper()), (3, phrase.replace("s", "\u017f"))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == ("cc", 1.0) and got[1][1] < 1 and got[3][1] < 1


def test_whole_licences_of_any_length(spark):
    """Whole texts under a title and a holder, some words changed; and one template of thousands of words."""
    assert len(licences.LICENCES) >= 10
    rows = []
    for i, (_, text) in enumerate(licences.LICENCES):
        w = text.split()
        w[20:20] = ["indeed"]
        del w[40]
        rows.append((i, "Some Licence\nCopyright (c) 2020 A. Holder " + " ".join(w) + " end of file"))
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(licences.LICENCES):
        assert label in got[i]["labels"].split(","), (label, got[i]["labels"])
    assert "mit-0-text" not in got[[x for x, _ in licences.LICENCES].index("zlib-text")]["labels"]
    long = " ".join(f"word{i}" for i in range(5000))
    rows = [(1, "a b " + long), (2, long.replace("word2500 ", "")), (3, " ".join(long.split()[:2000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(df, notices=(("long", long),)).collect()}
    assert got[1] == ("long", 1.0) and got[2][0] == "long" and 0.99 < got[2][1] < 1 and got[3] == ("", 0.0)
    span = license_scan.spans(df.where("doc_id = 1"), notices=(("long", long),)).first()
    assert (span["start"], span["end"]) == (2, 5002)
    full = " ".join(long.split()[:64])  # a block of 62 grams, all bits set
    span = license_scan.spans(spark.createDataFrame([(1, f"x {full} y")], "doc_id long, text string"), notices=(("full", full),)).first()
    assert (span["start"], span["end"], span["coverage"]) == (1, 65, 1.0)
