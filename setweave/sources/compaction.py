"""Consolidation of very many small files into few well-sized ones.

The work has three steps, all of them DataFrame plans:

1. ``freeze_manifest``: one row per file (path spellings resolved) with its bytes, records and checksum, written once so
   that planning, rewriting and reconciling see the same listing. Payloads are read for it, not shuffled.
2. ``plan_groups``: the manifest is ordered by a hash of the path, bytes are summed cumulatively, and a file's group is
   the interval of ``target_bytes`` in which it starts. The running sum is taken in two levels (within blocks of the
   order, then over the blocks' totals), so no task ever holds the whole manifest.
3. ``rewrite``: as the order is one by hash, a file's group follows from its path and the groups' first hashes. So each
   payload is shuffled once, to its group; each group becomes one output file, and what was written is compared with the
   manifest, file by file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setweave.runtime import drop_path, if_small, scratch_path, stash

#: Kinds of files that are indexed; case counts.
EXTENSIONS = ("txt", "html", "htm")
TARGET_BYTES = 128 * 1024 * 1024
#: Files of one block of the order; blocks' totals are what the second level of the running sum goes over.
FILES_PER_BLOCK = 100_000
#: Times from which a path counts as listed very often; such listings are cut to one before the shuffle.
OFTEN = 64
#: Bits of a path's place in the order.
ORDER_BITS = 60


def resolved_path(url: Column) -> Column:
    """The path that a spelling leads to: empty and ``.`` steps vanish, ``..`` takes back the step before it.

    A leading ``/`` stays; ``..`` above an absolute root vanishes, above a relative start it stays. Null stays null.
    """
    step = lambda acc, x: (
        F.when(x.isin("", "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((x == "..") & url.startswith("/"), acc)
        .otherwise(F.concat(acc, F.array(x)))
    )
    steps = F.aggregate(F.split(url, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(url.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(steps, "/"))


def place_of(path: Column) -> Column:
    """A path's place in the order of the manifest: the first 60 bits of its MD5 hash."""
    return F.conv(F.substring(F.md5(path), 1, ORDER_BITS // 4), 16, 10).cast("bigint")


def listing_of_tree(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A listing of a real folder tree: ``file_id, url, size_bytes, modified_at, payload``, read as binary files.

    A file's id is taken from its path. Contents are read only where a query needs the payload.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return found.select(place_of(F.col("path")).alias("file_id"), F.col("path").alias("url"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.decode("content", "utf-8").alias("payload"))


def _lines(payload: Column) -> Column:
    return F.split(payload, "\r?\n")


def _indexed(listing: DataFrame, file_id: str, url: str, size: str, modified: str, payload: str) -> DataFrame:
    """Rows of files that are indexed: ``path, h, id, modified, digest, bytes, content`` (null if it has no TAB)."""
    text = F.col(payload)
    rows = listing.select(
        resolved_path(F.col(url)).alias("path"), F.col(file_id).cast("bigint").alias("id"), F.col(modified).alias("modified"), F.xxhash64(text).alias("digest"),
        F.coalesce(F.when(F.col(size) > 0, F.col(size).cast("bigint")), F.octet_length(text).cast("bigint"), F.lit(0)).cast("bigint").alias("bytes"), F.when(text.contains("\t"), text).alias("content"),
    ).where(F.col("id").isNotNull() & F.col("path").rlike(rf"\.({'|'.join(EXTENSIONS)})$"))
    return rows.withColumn("h", place_of(F.col("path")))


def freeze_manifest(listing: DataFrame, file_id: str = "file_id", url: str = "url", size: str = "size_bytes", modified: str = "modified_at", payload: str = "payload") -> DataFrame:
    """One row per file that is indexed: ``path, h, file_id, row_id, digest, bytes, n_records, checksum, listed``.

    Rows whose spellings lead to one path are one file: ``file_id`` is the smallest of them, ``row_id`` the row whose
    content counts (the latest modified, then the smallest id, then the larger hash). Rows without a path or an id, and
    paths of other kinds, are no files. A size that is null or not positive is that of the payload. Extra columns are
    ignored.
    """
    records = F.filter(F.transform(_lines(F.col("content")), lambda x, i: F.when((i > 0) & x.contains("\t"), F.xxhash64(i + 1, x))), lambda x: x.isNotNull())
    rows = _indexed(listing, file_id, url, size, modified, payload).withColumn("records", records)
    checksum = F.aggregate("records", F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(x))
    held = F.struct("modified", (-F.col("id")).alias("minus_id"), "digest", "bytes", F.greatest(F.size("records"), F.lit(0)).cast("bigint").alias("n_records"), F.coalesce(checksum, F.lit(0)).alias("checksum"))
    files = rows.select("path", "h", "id", held.alias("held")).groupBy("path", "h").agg(F.min("id").alias("file_id"), F.max("held").alias("latest"), F.count(F.lit(1)).alias("listed"))
    return files.select("path", "h", "file_id", (-F.col("latest.minus_id")).alias("row_id"), *[F.col(f"latest.{c}").alias(c) for c in ("digest", "bytes", "n_records", "checksum")], "listed")


def plan_groups(manifest: DataFrame, target_bytes: int = TARGET_BYTES, files_per_block: int = FILES_PER_BLOCK) -> DataFrame:
    """``manifest`` with ``start_byte`` (bytes of all files before it in the order) and ``group_id``.

    The order is (hash of the path, path), so a crowded folder spreads over all blocks; the number of blocks follows the
    number of files. Paths of one hash share a group. An empty manifest gives an empty plan.
    """
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / files_per_block), F.lit(1)).cast("bigint")
    blocks = manifest.agg(n_blocks.alias("n_blocks"))
    placed = manifest.crossJoin(F.broadcast(blocks)).withColumn("block", F.floor(F.col("h") / F.lit(float(1 << ORDER_BITS)) * F.col("n_blocks"))).drop("n_blocks")
    totals = placed.groupBy("block").agg(F.sum("bytes").alias("block_bytes"))
    before = F.coalesce(F.sum("block_bytes").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("block", before.alias("block_start"))
    within = F.coalesce(F.sum("bytes").over(W.partitionBy("block").orderBy("h", "path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    started = placed.withColumn("within", within).join(offsets, "block").withColumn("start_byte", (F.col("block_start") + F.col("within")).cast("bigint"))
    group = F.floor(F.min("start_byte").over(W.partitionBy("block", "h")) / target_bytes).cast("int")
    return started.withColumn("group_id", group).drop("block", "block_start", "within")


def _with_group(rows: DataFrame, plan: DataFrame, n_groups: int) -> DataFrame:
    """``rows`` with the group of their place: the last one that begins at or before it.

    The groups' beginnings are looked up by the first bits of the place; the table of them has two rows a group at most.
    """
    bits = max(0, (n_groups - 1).bit_length())
    prefix = lambda h: F.shiftright(h, ORDER_BITS - bits)
    begins = plan.groupBy("group_id").agg(F.min("h").alias("from_h"))
    begins = begins.groupBy(prefix(F.col("from_h")).alias("prefix")).agg(F.sort_array(F.collect_list(F.struct("from_h", "group_id"))).alias("begins"), F.max("group_id").alias("last_group"))
    all_prefixes = rows.sparkSession.range(1 << bits).withColumnRenamed("id", "prefix").join(begins, "prefix", "left")
    earlier = F.coalesce(F.max("last_group").over(W.orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    table = stash(all_prefixes.select("prefix", "begins", earlier.alias("earlier")), "begins")
    own = F.element_at(F.filter("begins", lambda x: x["from_h"] <= F.col("h")), -1)["group_id"]
    found = rows.withColumn("prefix", prefix(F.col("h"))).join(if_small(table), "prefix")
    return found.withColumn("group_id", F.when(F.size(F.filter("begins", lambda x: x["from_h"] <= F.col("h"))) > 0, own).otherwise(F.col("earlier"))).drop("prefix", "begins", "earlier")


def records_of(plan: DataFrame, listing: DataFrame, n_groups: int, file_id: str = "file_id", url: str = "url", size: str = "size_bytes", modified: str = "modified_at", payload: str = "payload") -> DataFrame:
    """``group_id, file_id, line_no, record`` of every planned file: its lines after the first that hold a TAB; one
    partition per group.

    Lines end with LF or CRLF; ``line_no`` counts all lines from 1. Null, empty and header-only payloads have none.
    """
    rows = _indexed(listing, file_id, url, size, modified, payload).select("path", "h", "id", "modified", "digest", "content")
    often = if_small(stash(plan.where(F.col("listed") > OFTEN).select("path", F.col("file_id").alias("least_id"), "row_id", F.col("digest").alias("own")), "often"))
    once = rows.join(often, "path").where((F.col("id") == F.col("row_id")) & (F.col("digest") == F.col("own"))).groupBy("path", "h").agg(F.min("least_id").alias("id"), F.first("content").alias("content"))
    rows = rows.join(often.select("path"), "path", "left_anti").unionByName(once, allowMissingColumns=True)
    grouped = _with_group(rows, plan, n_groups).repartitionById(n_groups, F.col("group_id"))
    of_path = W.partitionBy("group_id", "path")
    first = F.row_number().over(of_path.orderBy(F.col("modified").desc_nulls_last(), "id", F.col("digest").desc()))
    kept = grouped.withColumn("k", first).withColumn("file_id", F.min("id").over(of_path)).where("k = 1 AND content IS NOT NULL")
    lines = kept.select("group_id", "file_id", F.posexplode(_lines(F.col("content"))).alias("pos", "record"))
    return lines.where((F.col("pos") > 0) & F.col("record").contains("\t")).select("group_id", "file_id", (F.col("pos") + 1).cast("int").alias("line_no"), "record")


@dataclass(frozen=True)
class Consolidated:
    """What ``consolidate`` wrote: its path, and the reconciled figures."""

    path: str
    n_files_in: int
    n_groups: int
    n_records: int


def _reconcile(store: DataFrame, plan: DataFrame) -> int:
    """The files of which the store holds other records than the manifest says."""
    written = store.groupBy("group_id", "file_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("line_no", "record")).alias("x"))
    planned = plan.where("n_records > 0").select("group_id", "file_id", F.col("n_records").alias("n"), F.col("checksum").alias("x"))
    both = written.select("*", F.lit(1).alias("side")).unionByName(planned.select("*", F.lit(-1).alias("side")))
    return both.groupBy("group_id", "file_id", "n", "x").agg(F.sum("side").alias("s")).where("s <> 0").count()


def consolidate(spark: SparkSession, listing: DataFrame, out: str | None = None, target_bytes: int = TARGET_BYTES, files_per_block: int = FILES_PER_BLOCK) -> Consolidated:
    """Write the records of ``listing`` into one file per group under ``out`` and reconcile them.

    Raises ``RuntimeError``, and deletes what was written, if the store's records of any file differ in number or
    checksum from the manifest's: nothing may be lost or doubled. Rows listed twice under one id count once.
    """
    manifest = stash(freeze_manifest(listing), "manifest")
    plan = stash(plan_groups(manifest, target_bytes, files_per_block), "groups")
    shape = plan.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("group_id").alias("groups"), (F.coalesce(F.max("group_id"), F.lit(0)) + 1).alias("wide"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("records")).first()
    out = out or scratch_path(spark, "store")
    # one task per group: the group's number is the partition's number, so a group is exactly one file
    records_of(plan, listing, int(shape["wide"])).sortWithinPartitions("group_id", "file_id", "line_no").write.parquet(out)
    if wrong := _reconcile(spark.read.parquet(out), plan):
        drop_path(spark, out)
        raise RuntimeError(f"the store at {out} had other records than the source in {wrong} files; it was deleted")
    return Consolidated(out, shape["files"], shape["groups"], shape["records"])


def read_store(spark: SparkSession, store: Consolidated | str) -> DataFrame:
    """The consolidated records: ``group_id, file_id, line_no, record``."""
    return spark.read.parquet(store.path if isinstance(store, Consolidated) else store)
