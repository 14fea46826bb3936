"""Reconciling a listing of remote files with what is there: by content hash, then by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import NAME, is_wav, name_parts

# Fixed value: upload folders whose names begin with a number and a sender; they come last.
PREFIXED = r"^\d+-.* - "


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")


def copy_rank(path: Column) -> Column:
    """Plain folder before prefixed, shallow before deep, then by path."""
    return F.struct(F.substring_index(path, "/", 1).rlike(PREFIXED).alias("prefixed"), F.regexp_count(path, F.lit("/")).alias("depth"), path.alias("path"))


def choose_copy(files: DataFrame) -> DataFrame:
    """(hash, size, path) -> one row a hash, the copy of best rank; a partial aggregate."""
    best = files.groupBy("hash").agg(F.min_by(F.struct("path", "size"), copy_rank(F.col("path"))).alias("c"))
    return best.select("hash", "c.path", "c.size", name_of(F.col("c.path")).alias("name"))


def diff(remote: DataFrame, local: DataFrame, replaced: DataFrame) -> DataFrame:
    """Remote WAVs with a category, by these rules in order.

    nohash (no hash), local (hash in local), replaced (hash in replaced): a row for each file.
    Of the rest a row for each hash, for the copy chosen: bad_name, clash_local (its name is local
    with other content), clash_remote (two chosen copies share a name), new.
    """
    wavs = remote.where(is_wav(name_of(F.col("path")))).withColumn("hash", F.nullif("hash", F.lit("")))
    here = local.select("hash", F.lit(True).alias("_local")).where("hash is not null").distinct()
    gone = replaced.select("hash", F.lit(True).alias("_replaced")).where("hash is not null").distinct()
    known = wavs.join(here, "hash", "left").join(gone, "hash", "left")
    early = F.when(F.col("hash").isNull(), "nohash").when(F.col("_local"), "local").when(F.col("_replaced"), "replaced")
    known = known.withColumn("category", early)
    files = known.where("category is not null").select("hash", "path", "size", name_of(F.col("path")).alias("name"), "category")
    names = local.select("name", F.lit(True).alias("_taken")).distinct()
    chosen = choose_copy(known.where("category is null")).join(names, "name", "left")
    late = F.when(~F.col("name").rlike(NAME), "bad_name").when(F.col("_taken"), "clash_local")
    chosen = chosen.withColumn("category", late)
    same = F.count(F.when(F.col("category").isNull(), 1)).over(Window.partitionBy("name"))
    chosen = chosen.withColumn("category", F.coalesce("category", F.when(same > 1, "clash_remote").otherwise("new")))
    return files.unionByName(chosen.select("hash", "path", "size", "name", "category"))


def select_for_pull(remote: DataFrame, compared: DataFrame, folder: str | None = None, include_clashes: bool = False) -> DataFrame:
    """hash, path, size, name of one copy a hash to fetch; copies outside ``folder`` are left out before one is chosen."""
    wanted = ["new", "clash_local"] if include_clashes else ["new"]
    hashes = compared.where(F.col("category").isin(wanted)).select("hash")
    copies = remote.where(is_wav(name_of(F.col("path")))).join(hashes, "hash", "left_semi")
    if folder is not None:
        copies = copies.where(F.contains(folder_of(F.col("path")), F.lit(folder)))
    return choose_copy(copies)


def plan_merge(staged: DataFrame, local: DataFrame) -> DataFrame:
    """name, action: new, or clash if the name is there."""
    names = local.select("name", F.lit(True).alias("_there")).distinct()
    return staged.select("name").distinct().join(names, "name", "left").select("name", F.when(F.col("_there"), "clash").otherwise("new").alias("action"))


def stale(cache: DataFrame, present: DataFrame) -> DataFrame:
    """Names whose size or mtime isn't as cached, or that aren't cached: what has to be hashed again."""
    same = cache.select("name", "size", "mtime_ns")
    return present.join(same, ["name", "size", "mtime_ns"], "left_anti").select("name", "size", "mtime_ns")


def refreshed(cache: DataFrame, present: DataFrame, hashed: DataFrame) -> DataFrame:
    """The cache after hashing: still valid rows and new ones; names gone from disk are dropped."""
    valid = cache.join(present.select("name", "size", "mtime_ns"), ["name", "size", "mtime_ns"], "left_semi")
    fresh = present.join(hashed.select("name", "hash"), "name").join(valid.select("name"), "name", "left_anti")
    return valid.select("name", "size", "mtime_ns", "hash").unionByName(fresh.select("name", "size", "mtime_ns", "hash"))


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """name, ok, fail: expected (name, hash, size) against found (name, hash, size, qc_ok, qc_reason).

    Reasons in a fixed order: missing, hash mismatch, size mismatch, bad name, qc: ... A found name
    that isn't expected fails as unexpected if it is a WAV and is reported otherwise.
    """
    e, f = expected.alias("e"), found.alias("f")
    both = e.join(f, F.col("e.name") == F.col("f.name"), "full_outer")
    known, there = F.col("e.name").isNotNull(), F.col("f.name").isNotNull()
    name = F.coalesce("e.name", "f.name")
    reason = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), text)
    fail = F.concat_ws(
        "; ", reason(known & ~there, "missing"),
        reason(known & there & ~F.col("e.hash").eqNullSafe(F.col("f.hash")), "hash mismatch"),
        reason(known & there & (F.col("e.size") != F.col("f.size")), "size mismatch"),
        reason(known & ~name.rlike(NAME), "bad name"),
        reason(known & there & ~F.coalesce("f.qc_ok", F.lit(False)), F.concat(F.lit("qc: "), F.coalesce("f.qc_reason", F.lit("")))),
        reason(~known & is_wav(name), "unexpected"),
    )
    return both.select(name.alias("name"), (fail == "").alias("ok"), fail.alias("fail"))


def rekey(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """instance_id, status over both tables: keep, changed, pending (not embedded) or dropped.

    wanted (instance_id, file_sig), cached (instance_id, file_sig, done). A cached row stays if it is
    done and its signature is null or the same; one that is done with another signature is changed.
    """
    w, c = wanted.alias("w"), cached.alias("c")
    both = w.join(c, F.col("w.instance_id") == F.col("c.instance_id"), "full_outer")
    done = F.coalesce(F.col("c.done"), F.lit(False))
    same = F.col("c.file_sig").isNull() | (F.col("c.file_sig") == F.col("w.file_sig"))
    status = F.when(F.col("w.instance_id").isNull(), "dropped").when(~done, "pending").when(same, "keep").otherwise("changed")
    return both.select(F.coalesce("w.instance_id", "c.instance_id").alias("instance_id"), status.alias("status"))


def runs(rows: DataFrame, at: str, gap: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, first, last, n: runs of times no more than ``gap`` apart (a gap of just that stays in)."""
    w = F.session_window(F.col(at), gap)
    return rows.groupBy(*keys, w.alias("w")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("w")


def clips_per_hour(files: DataFrame, start: str = "start") -> DataFrame:
    """One row: fewest and most files an hour, and the distinct minute:second offsets if at most 6."""
    hour = F.date_trunc("hour", start)
    per = files.groupBy(hour.alias("hour")).agg(F.count("*").alias("n")).agg(F.min("n").alias("fewest"), F.max("n").alias("most"))
    marks = files.select(F.date_format(start, "mm:ss").alias("m")).distinct().orderBy("m").limit(7).agg(F.sort_array(F.collect_list("m")).alias("m"))
    offsets = F.when(F.size("m") <= 6, F.array_join("m", " "))
    return per.crossJoin(marks).select("fewest", "most", offsets.alias("offsets"))


#: Fixed value: bytes of a block of a composite content hash.
HASH_BLOCK = 4 << 20
#: Fixed value: names of batches, a letter or digit and then letters, digits, dots, dashes and underscores.
BATCH_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def block_hash(content: Column, block: int = HASH_BLOCK) -> Column:
    """Composite hash of bytes: sha256 over the sha256 digests of blocks; that of nothing for empty content."""
    starts = F.when(F.octet_length(content) > 0, F.sequence(F.lit(0), F.floor((F.octet_length(content) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    digests = F.transform(starts, lambda i: F.sha2(F.substring(content, i * block + 1, F.lit(block)), 256))
    return F.sha2(F.unhex(F.array_join(digests, "")), 256)


def seeded_cache(hashes: DataFrame, written_ns: int, listing: DataFrame, files: DataFrame) -> DataFrame:
    """A cache from an old list of hashes (name, hash): name, size, mtime_ns, hash.

    An entry is kept only if its file (name, size, mtime_ns, ctime_ns) was last changed before the list
    was written and a listing (hash, size) gives the hash the size that the file has.
    """
    vouched = listing.where("hash is not null").select("hash", "size").distinct()
    there = files.where(F.col("ctime_ns") < written_ns)
    # a hash has few sizes, a name may have very many files: the size narrows the join by name
    return hashes.join(vouched, "hash").join(there, ["name", "size"]).select("name", "size", "mtime_ns", "hash")


def is_batch_name(name: Column) -> Column:
    return F.coalesce(name.rlike(BATCH_NAME), F.lit(False))


def merge_refusals(verified: DataFrame, plan: DataFrame, replace: bool = False) -> DataFrame:
    """(name, ok, fail) of verify and (name, action) of plan_merge -> name, reason: why a merge may not go on.

    Files that failed or were never verified, and clashes unless they are to be replaced.
    """
    both = plan.join(verified, "name", "left")
    reason = (
        F.when(F.col("ok").isNull(), "not verified").when(~F.col("ok"), F.concat(F.lit("failed: "), "fail"))
        .when((F.col("action") == "clash") & F.lit(not replace), "would replace another file")
    )
    return both.select("name", reason.alias("reason")).where("reason is not null")


def by_folder(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, folder, files, hashes (distinct), gb of (path, hash, size); files at the top are in '.'."""
    folder = F.coalesce(F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    return files.groupBy(*keys, folder.alias("folder")).agg(F.count("*").alias("files"), F.count_distinct("hash").alias("hashes"), (F.sum("size") / 1e9).alias("gb"))


def rejects(scanned: DataFrame, quality: DataFrame) -> DataFrame:
    """(name) and (name, qc_ok, qc_reason) -> name, reason of files that no bag may use: names that don't parse, failed checks."""
    both = scanned.select("name").join(quality, "name", "left")
    reason = F.when(F.col("p").isNull(), "unparsed filename").when(F.col("qc_ok").isNull(), "not checked").when(~F.col("qc_ok"), F.col("qc_reason"))
    return both.withColumn("p", name_parts(F.col("name"))).select("name", reason.alias("reason")).where("reason is not null")
