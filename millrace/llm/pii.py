"""Personal data in texts, with DataFrame functions only.

Base spans come from patterns (email, ip, card, phone). The corpus then says which plain terms give
a found value away: if a term's documents nearly coincide with a value's, the pointwise mutual
information of the two comes near the whole information content of the value, and the term is
generalised. ``find`` reports terms that stand next to the value, as the query's SQL defines it;
``redact`` counts and replaces terms wherever they stand in the documents that hold the value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, stored

KINDS = ("email", "ip", "card", "phone")

# The patterns find the same places as the plain ones in the comments, in time linear in the text:
# runs are entered at their start only (or where the last match ended) and never given back.
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.|$)){4}$"
# [0-9]([\x20-]?[0-9])+ with 14 to 19 digits, which are decided here because runs can't overlap
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A word of letters that is a whole white-space token, but for punctuation around it. No base span
#: contains such a token, so terms and base spans never overlap.
TERM = r"""(?<=[\s(\["'])\p{L}{3,}(?=[,;:!?.)\]"']*+\s)"""

#: Share of a value's information content that a term may give away.
THRESHOLD = 0.9
_STEP = 128
#: Characters of a chunk of a text, chunks of a section: a place of a long text is looked up in its chunk.
_CHUNK, _SECTION = 4096, 64


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    digit = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")  # noqa: E731  from the right, from 0
    part = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), part), F.lit(0), lambda s, x: s + x) % 10 == 0


_VALID = (
    lambda v: F.lit(True),
    lambda v: v.rlike(IP_PARTS),
    _luhn,
    lambda v: F.length(_digits(v)).between(10, 15),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once; a column named in a lambda would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def _chunks(text: Column) -> Column:
    """A text as an array of chunks of _CHUNK code points; the last may be shorter, an empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}+"), F.lit(0))


def _part(chunks: Column, start: Column, size: Column) -> Column:
    """substring of the text of the chunks; its cost is that of the chunks it touches."""
    first = F.floor(start / _CHUNK).cast("int")
    last = F.greatest(first, F.floor((start + size - 1) / _CHUNK).cast("int"))
    return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * _CHUNK + 1, size)


def _places(text: str, pattern: str, when: Column | None = None) -> Column:
    """Array of (start, end, value) of the pattern's matches in a text that isn't null, in code points.

    Splitting at the matches gives the lengths between them. Their running sums are taken over
    blocks of _STEP, so that a text with many matches costs n**1.5 and not n**2 additions.
    """
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(hits: Column, gaps: Column, steps: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _STEP).cast("int"))
        sums = F.transform(blocks, lambda b: add(F.slice(steps, b * _STEP + 1, F.lit(_STEP))))

        def place(sums: Column, hit: Column, i: Column) -> Column:
            b = F.floor(i / _STEP).cast("int")
            start = add(F.slice(sums, F.lit(1), b)) + add(F.slice(steps, b * _STEP + 1, i - b * _STEP)) + gaps[i]
            return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value"))

        return _let(sums, lambda s: F.transform(hits, lambda hit, i: place(s, hit, i)))

    def found(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        steps = lambda g: F.transform(hits, lambda h, i: g[i] + F.length(h))
        return F.when(F.size(hits) == 0, none).otherwise(_let(gaps, lambda g: _let(steps(g), lambda s: placed(hits, g, s))))

    places = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)
    return places if when is None else F.when(when, places).otherwise(none)


def _valid(k: int, places: Column) -> Column:
    """The places of kind k that pass its test, as spans."""
    kept = F.filter(places, lambda s: _VALID[k](s["value"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with ``name``: array of (start, kind, end, value) by start, then kind as listed."""
    when = (F.contains(F.col(text), F.lit("@")), None, None, F.contains(F.col(text), F.lit("+")))
    found = [_valid(k, _places(text, pattern, when[k])) for k, pattern in enumerate((EMAIL, IP, CARD, PHONE))]
    return df.withColumn(name, F.array_sort(F.concat(*found)))


def _entity(span: Column) -> Column:
    return F.xxhash64(span["kind"], F.lower(span["value"]))


def whole_text_terms(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key (md5 of the text) -> terms: array of the terms, in lower case, that give a value of that text away.

    n_et counts the rows of docs that hold value and term, at any distance. Values of the same texts
    have the same counts for all terms and are one class, so a text full of values that are nowhere
    else isn't multiplied. Texts are never moved, only the values and terms of those that have values.
    """
    text = F.coalesce("text", F.lit(""))
    # a blank on either side, so that the first and the last word count as whole
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(TERM), F.lit(0)), F.lower))
    found = base_spans(docs.select(F.md5(text).alias("key"), text.alias("text")), "text", "base").where(F.size("base") > 0)
    entities = F.array_distinct(F.transform("base", _entity))
    # copies of a text are one row and a count, added up in the tasks first
    holders = found.select("key", entities.alias("entities"), words.alias("words")).groupBy("key")
    holders = stored(holders.agg(F.count("*").alias("c"), F.first("entities").alias("entities"), F.first("words").alias("words")))
    n = F.lit(docs.count()).cast("double")
    held = holders.select("key", "c", F.explode("entities").alias("entity"))
    mix = [F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"x{i}") for i in (0, 1)]
    n_e = broadcast_if_small(cut(held.groupBy("entity").agg(F.sum("c").alias("n_e"), *mix)))
    content = F.log(n / F.col("n_e"))
    classes = cut(held.join(n_e, "entity").where(content > 0).select("key", "c", "n_e", F.struct("n_e", "x0", "x1").alias("class")).distinct())
    # n_et is at most n_e, so a term too common for a full n_et can't reach the threshold; a text's commonest value allows most
    able = F.log(n / F.col("n_t")) + 1e-9 >= threshold * content
    most = broadcast_if_small(cut(classes.groupBy("key").agg(F.max("n_e").alias("n_e"))))
    present = holders.select("key", F.explode("words").alias("term")).join(most, "key")
    n_t = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    rare = cut(present.join(n_t, "term").where(able).select("key", "term", "n_t"))
    pairs = cut(rare.join(classes, "key").where(able))
    met = pairs.groupBy("class", "term").agg(F.sum("c").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    pmi = F.log(F.col("n_et") * n / (F.col("n_e") * F.col("n_t")))
    telling = broadcast_if_small(cut(met.where(pmi >= threshold * content).select("class", "term")))
    return pairs.join(telling, ["class", "term"], "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def _named(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, (*KINDS, "term"))), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def _all_spans() -> Column:
    short = lambda s, k: F.struct(s["start"].alias("start"), k.alias("kind"), s["end"].alias("end"))
    terms = F.coalesce(F.col("terms"), F.array().cast("array<struct<start:int,end:int>>"))
    return F.array_sort(F.concat(F.transform("base", lambda s: short(s, s["kind"])), F.transform(terms, lambda s: short(s, F.lit(len(KINDS))))))


def _with_terms(rows: DataFrame, telling: DataFrame) -> DataFrame:
    """rows (key, whole, base) with ``terms``: (start, end) of the places of the terms that tell on a value of the text."""
    rows = rows.join(telling.withColumnRenamed("terms", "telling"), "key", "left").withColumn("around", F.concat(F.lit(" "), "whole", F.lit(" ")))
    places = _places("around", TERM, F.col("telling").isNotNull())
    places = F.filter(places, lambda t: F.array_contains(F.col("telling"), F.lower(t["value"])))
    return rows.withColumn("terms", F.transform(places, lambda t: F.struct((t["start"] - 1).alias("start"), (t["end"] - 1).alias("end")))).drop("around", "telling")


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs.

    Null texts count as empty; texts without personal data have counts 0 and no spans, whatever the
    corpus says, so clean documents are left alone. Rows with equal texts get equal results. A term is
    counted with the values of its whole text, however far they stand, and listed at all its places in
    the texts that hold a value it gives away, as ``redact`` replaces it. Very long texts are read once.
    """
    telling = broadcast_if_small(cut(whole_text_terms(docs, threshold)))
    text = F.coalesce("text", F.lit(""))
    rows = base_spans(docs.select("doc_id", F.md5(text).alias("key"), text.alias("whole")), "whole", "base")
    done = _with_terms(rows, telling)

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return done.select("doc_id", *map(count, range(len(KINDS))), F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(_all_spans()).alias("spans"))


def redacted_text(text: Column, spans: Column) -> Column:
    """text with [KIND] in place of each span (start, kind, end), sorted; overlapping ones become one.

    A span that starts where all before it have ended is fresh: it shows the text since then and its
    label. The text is put together chunk by chunk from the fresh spans that touch it, so neither a
    long text nor many spans are gone through again for each span.
    """
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")))

    def fresh(ends: Column, tops: Column) -> Column:
        def done(i: Column) -> Column:
            b = F.floor(i / _STEP).cast("int")
            return F.coalesce(F.greatest(F.array_max(F.slice(tops, F.lit(1), b)), F.array_max(F.slice(ends, b * _STEP + 1, i - b * _STEP))), F.lit(0))

        item = lambda d, at, label: F.struct(d.alias("done"), at.alias("start"), label.alias("label"))
        items = F.transform(spans, lambda s, i: item(done(i), s["start"], F.element_at(labels, s["kind"] + 1)))
        last = item(done(F.size(spans)), F.length(text), F.lit(""))
        return F.filter(F.concat(items, F.array(last)), lambda x: x["start"] >= x["done"])

    def shown(chunk: Column, a: Column, items: Column) -> Column:
        b = a + _CHUNK
        touching = F.filter(items, lambda x: (x["start"] >= a) & (x["done"] < b))

        def piece(x: Column) -> Column:
            since = F.greatest(x["done"], a)
            plain = F.substring(chunk, since - a + 1, F.least(x["start"], b) - since)
            return F.concat(plain, F.when(x["start"].between(a, b - 1), x["label"]).otherwise(""))

        return F.array_join(F.transform(touching, piece), "")

    def section(chunks: Column, items: Column, k: Column) -> Column:
        a = k * (_SECTION * _CHUNK)
        mine = F.filter(items, lambda x: (x["start"] >= a) & (x["done"] < a + _SECTION * _CHUNK))
        of = F.slice(chunks, k * _SECTION + 1, F.lit(_SECTION))
        return _let(mine, lambda m: F.array_join(F.transform(of, lambda c, j: shown(c, a + j * _CHUNK, m)), ""))

    def whole(chunks: Column, items: Column) -> Column:
        sections = F.sequence(F.lit(0), F.floor((F.size(chunks) - 1) / _SECTION).cast("int"))
        return F.array_join(F.transform(sections, lambda k: section(chunks, items, k)), "")

    steps = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _STEP).cast("int"))
    tops = lambda ends: F.transform(steps, lambda b: F.array_max(F.slice(ends, b * _STEP + 1, F.lit(_STEP))))
    items = _let(F.transform(spans, lambda s: s["end"]), lambda ends: _let(tops(ends), lambda t: fresh(ends, t)))
    return F.when(F.size(spans) == 0, text).otherwise(_let(_chunks(text), lambda c: _let(items, lambda i: whole(c, i))))


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with personal data and disclosing terms in text replaced; other columns and rows unchanged.

    A disclosing term is replaced at all its places in every text that holds the value.
    A null text stays null. n_chars, if there, is left as it is for the caller to renew.
    """
    telling = broadcast_if_small(cut(whole_text_terms(docs, threshold)))
    text = F.coalesce("text", F.lit(""))
    rows = base_spans(docs.select(F.struct(*docs.columns).alias("row"), F.md5(text).alias("key"), text.alias("whole")), "whole", "base")
    rows = _with_terms(rows, telling).withColumn("spans", _all_spans())
    new = F.when(F.size("spans") > 0, redacted_text(F.col("whole"), F.col("spans"))).otherwise(F.col("row.text"))
    return rows.withColumn("text", new).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
