"""Language identification by Bayesian fusion of evidence.

For each row and language: the likelihood of the text (hashed byte n-grams), of the language its
markup declares, of its address suffix, and the prior of its host. All but the text model are
grouped counts over the whole table, weighted with what the texts alone say; a host's counts are
smoothed with its domain's, those with its suffix's, those with the table's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut, raw, utf8
from .training import fitted

#: Bytes of an n-gram, bits of its hash, texts a language to learn from.
GRAM, BITS, PER_LANGUAGE = 3, 14, 300
#: Languages that are told apart, at most: the commonest tags of the column lang. And texts in all.
LANGUAGES, SAMPLE = 256, 9600
#: Weight of all languages' n-grams in each language's, in roots of a text's n-grams.
SHARED = 50.0
#: Weight of an n-gram: neighbouring ones overlap and aren't independent.
TEMPER = 1 / GRAM
#: Rows that a level of the hierarchy borrows from the next one; the same for the other counts.
BORROW = 5.0
#: A row is rejected below this probability, or if its text has no letter.
LEAST = 0.5
_SLICE = 1 << 20


def _grams(text: str | bytes | None) -> np.ndarray:
    """Counts of the hashed byte n-grams of a whole text, A-Z lower-cased, white space and digits one blank."""
    data = np.frombuffer(b" " + raw(text).lower() + b" ", dtype=np.uint8)
    data = np.where((data < 97) | ((data > 122) & (data < 128)), np.uint8(32), data)
    out = np.zeros(1 << BITS, dtype=np.int64)
    for a in range(0, len(data) - GRAM + 1, _SLICE):
        part = data[a : a + _SLICE + GRAM - 1].astype(np.uint32)
        h = np.zeros(len(part) - GRAM + 1, np.uint32)
        for k in range(GRAM):
            h = (h << np.uint32(8)) | part[k : k + len(h)]
        h = h[h != 0x202020] * np.uint32(0x9E3779B1)
        out += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def train_texts(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages (from the column lang, sorted) and a matrix of log probabilities of their n-grams.

    Tags beyond the LANGUAGES commonest (ties by name) are no languages of their own; rows that bear
    them are identified among the others. Learned from the ``per_language`` rows of smallest id hash of
    each language, SAMPLE rows in all: a bounded sample.
    """
    order = F.md5(F.concat(F.lit("lang:"), F.col("doc_id").cast("string")))
    ids = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "lang")
    # tasks keep only the first rows of each language before the shuffle
    first = Window.partitionBy("lang").orderBy(order, "doc_id")
    few = ids.withColumn("i", F.row_number().over(first)).where(F.col("i") <= per_language)
    tags = docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    languages = sorted(r["lang"] for r in tags.collect())
    if not languages:
        return [], np.zeros((0, 1 << BITS))
    few = cut(few.where(F.col("lang").isin(languages) & (F.col("i") <= max(1, SAMPLE // len(languages)))).select("doc_id", "lang"))
    sample = docs.select("doc_id", "text", "lang").join(broadcast_if_small(few), ["doc_id", "lang"], "left_semi")

    def fit(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        counts = np.zeros((len(languages), 1 << BITS))
        for text, lang in zip(rows["text"], rows["lang"], strict=True):
            g = _grams(text)
            counts[languages.index(lang)] += g / max(1.0, np.sqrt(g.sum()))  # a long text counts as its root
        # smoothed with all languages together, so that one with few texts is near them and not even
        shared = counts.sum(axis=0) + 0.1
        counts += SHARED * shared / shared.sum()
        return {"logp": np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)}

    # languages that no text with an id has are near all others together
    return languages, fitted(sample, fit).get("logp", np.full((len(languages), 1 << BITS), -np.log(1 << BITS)))


def _text_logs(text: Column, logp: np.ndarray) -> Column:
    """Array of each language's tempered log likelihood; null if the text has no letter."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def logs(texts: pa.Array) -> pa.Array:
        out = []
        for t in utf8(texts):
            g = _grams(t)
            at = np.flatnonzero(g)
            out.append((TEMPER * (logp[:, at] @ g[at])).tolist() if len(at) else None)
        return pa.array(out, pa.list_(pa.float64()))

    return logs(text)


def _normal(logs: Column) -> Column:
    """Logs of probabilities as probabilities that sum to 1."""
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda s, y: s + y))


def _soft_counts(rows: DataFrame, by: str, n: int) -> DataFrame:
    """by, counts: array of the sums of the texts' probabilities; a partial aggregate, so hot values are no matter."""
    sums = rows.where(f"{by} is not null and p is not null").groupBy(by).agg(*(F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(n)))
    return sums.select(by, F.array(*(f"c{i}" for i in range(n))).alias("counts"))


def identify(rows: DataFrame, languages: list[str], logp: np.ndarray, *keep: str, narrow: bool = True) -> DataFrame:
    """Columns ``keep``, then lang, probability, text_lang, rejected, for rows with text, declared, host, domain, suffix.

    Null evidence counts for nothing, a null text too. declared is a language tag of which the first
    part counts. A row is rejected if no language reaches LEAST or its text has no letter; its lang
    is null. Ties go to the language first in order. Without any language all rows are rejected.

    With ``narrow`` the kept columns are held with the texts' likelihoods; otherwise these are made
    twice, once for the counts and once for the result, so that wide rows are never moved.
    """
    n = len(languages)
    if not n:
        none = F.lit(None).cast("string")
        return rows.select(*keep, none.alias("lang"), F.lit(0.0).alias("probability"), none.alias("text_lang"), F.lit(True).alias("rejected"))
    tag = F.nullif(F.regexp_extract(F.lower("declared"), r"^\s*([a-z]{2,3})(?:[-_]|\s*$)", 1), F.lit(""))
    scored = rows.select(*keep, tag.alias("declared"), "host", "domain", "suffix", _text_logs(F.col("text"), logp).alias("logs"))
    scored = scored.withColumn("p", F.when(F.col("logs").isNotNull(), _normal(F.col("logs"))))
    rows = cut(scored if narrow else scored.drop(*keep))
    scored = rows if narrow else scored
    whole = rows.where("p is not null").agg(*(F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(n))).first()
    base = [(c + 1.0) / (sum(whole) + n) for c in whole]
    flat = F.array(*map(F.lit, base))

    def smoothed(counts: Column, prior: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(counts, prior, lambda c, q: (c + BORROW * q) / (total + BORROW))

    def given(by: str) -> DataFrame:
        """P(value | language) of a column, up to a factor that is the same for all languages."""
        return _soft_counts(rows, by, n).select(by, F.transform("counts", lambda c, i: F.log((c + BORROW * 0.01) / (flat[i] * sum(whole) + BORROW))).alias(f"{by}_logs"))

    # hosts, with the domain and the suffix they belong to
    suffix = _soft_counts(rows, "suffix", n).select("suffix", smoothed(F.col("counts"), flat).alias("of_suffix"))
    places = rows.where("host is not null").groupBy("host").agg(F.min("domain").alias("domain"), F.min("suffix").alias("suffix"))
    domains = _soft_counts(rows, "domain", n).join(places.where("domain is not null").groupBy("domain").agg(F.min("suffix").alias("suffix")), "domain").join(suffix, "suffix", "left")
    domains = domains.select("domain", smoothed(F.col("counts"), F.coalesce("of_suffix", flat)).alias("of_domain"))
    hosts = _soft_counts(rows, "host", n).join(places, "host").join(domains, "domain", "left").select("host", smoothed(F.col("counts"), F.coalesce("of_domain", flat)).alias("prior"))
    found = scored.join(broadcast_if_small(cut(hosts)), "host", "left")
    for by in ("declared", "suffix"):
        found = found.join(broadcast_if_small(cut(given(by))), by, "left")
    zero = F.array(*[F.lit(0.0)] * n)
    parts = (F.coalesce("logs", zero), F.coalesce("declared_logs", zero), F.coalesce("suffix_logs", zero), F.transform(F.coalesce("prior", flat), F.ln))
    summed = F.transform(F.arrays_zip(*(x.alias(f"x{i}") for i, x in enumerate(parts))), lambda z: z["x0"] + z["x1"] + z["x2"] + z["x3"])
    found = found.withColumn("posterior", summed).withColumn("posterior", _normal(F.col("posterior")))
    name = lambda logs: F.element_at(F.array(*map(F.lit, languages)), F.array_position(logs, F.array_max(logs)).cast("int"))
    probability = F.array_max("posterior")
    rejected = F.col("logs").isNull() | (probability < LEAST)
    return found.select(*keep, F.when(~rejected, name(F.col("posterior"))).alias("lang"), probability.alias("probability"), F.when(F.col("logs").isNotNull(), name(F.col("logs"))).alias("text_lang"), rejected.alias("rejected"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host, domain, suffix of raw pages (url, html); scripts, styles and tags are blanked."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>|&#?\w{1,31};", " ")
    declared = F.regexp_extract(html, r"""(?is)<html\b[^<>]*?\slang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    named = pages.select("page_id", bare.alias("text"), declared.alias("declared"), host.alias("host"))
    domain = F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit(""))
    return named.withColumns({"domain": domain, "suffix": suffix})


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, rejected for every page; the text model is learned from docs.

    Pages without html or of no letter are rejected, those without an address have no host, domain and
    suffix evidence; repeated pages each have a row and count each; other columns are not read.
    """
    return identify(page_evidence(pages), *train_texts(docs), "page_id")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is identified, lang replaced by it, other columns unchanged.

    The column lang is the declared language, source the host. Texts without any letter and rows in
    which no language reaches LEAST are rejected.
    """
    none = F.lit(None).cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("lang").alias("declared"), F.col("source").alias("host"), "text", none.alias("domain"), none.alias("suffix"))
    kept = identify(rows, *train_texts(docs), "row", narrow=False).where("not rejected")
    return kept.select(*(F.col("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))
