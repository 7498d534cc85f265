"""Duplicates hidden by formatting: one record per canonical form, with the number of its copies."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.runtime import stash

#: What canonicalization ignores: white space and punctuation of all scripts, and the ASCII punctuation that Unicode
#: counts as symbols. Punctuation that is newer than the Java virtual machine's tables is added by number.
IGNORED = r"[\p{IsWhite_Space}\p{IsPunctuation}$+<=>^`|~\u061D\u1B7D\u1B7E\u2E53-\u2E5D]+"
SEPARATOR = "::"


def canonical(content: Column) -> Column:
    """The canonical form: fields lower-cased and stripped of what is ignored, in sorted order.

    A record is what is left and right of the first ``::``, or one field. Fields are joined by U+0001, so ``a::b`` and
    ``ab`` stay apart, and so do ``a::`` and ``a``. Null if there is no letter or digit. Symbols such as the degree sign
    are kept: they may be all that tells two records apart.
    """
    fields = F.transform(F.split(F.lower(content), SEPARATOR, 2), lambda x: F.regexp_replace(x, IGNORED, ""))
    return F.when(content.rlike(r"[\p{L}\p{N}]"), F.array_join(F.array_sort(fields), "\u0001"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x.as_py()).casefold()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "content"])


def folded(rows: DataFrame, kind: str) -> DataFrame:
    """``id, content`` with characters in their compatibility form and full case folding: ``Straße`` is ``strasse``, ``ﬁx``
    is ``fix``, full-width letters are the usual ones. Only rows with other characters than ASCII leave the JVM."""
    other = F.col("content").rlike(r"[^\x00-\x7F]")
    return rows.where(~other).unionByName(rows.where(other).mapInArrow(_folded, f"id {kind}, content string"))


def keyed(rows: DataFrame, id_col: str, content_col: str, fold: bool = False) -> DataFrame:
    """``id, h1, h2, chk``: 128 bits of hash of the canonical form and 64 more, from another function, to check them.

    With ``fold`` characters that mean the same are the same as well (``folded``); without it only case, white space,
    punctuation and the order of fields are ignored.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    rows = folded(rows, rows.schema["id"].dataType.simpleString()) if fold else rows
    form = rows.select("id", canonical(F.col("content")).alias("form")).where("form IS NOT NULL AND id IS NOT NULL")
    digest = form.select("id", F.md5("form").alias("m"), F.xxhash64("form").alias("chk"))
    half = lambda a: F.conv(F.substring("m", a, 16), 16, -10).cast("bigint")
    return digest.select("id", half(1).alias("h1"), half(17).alias("h2"), "chk")


KEY = ["h1", "h2", "chk"]


def collapse(rows: DataFrame, id_col: str = "ext_id", content_col: str = "content", fold: bool = False) -> DataFrame:
    """One row per record: ``keep_id`` (the smallest id), ``n_copies``, ``collided``.

    Counts are combined before the shuffle, so a record of which there are billions of copies costs one row per task.
    The check hash is part of the key: should two forms share the 128 bits, they are kept apart and ``collided`` says so.
    Repeated ids count as copies; rows without a record (null, empty, letterless) or without an id are left out.
    """
    groups = stash(keyed(rows, id_col, content_col, fold).groupBy(KEY).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")), "forms")
    checked = groups.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1").select("h1", "h2", F.lit(True).alias("hit"))
    return groups.join(checked, ["h1", "h2"], "left").select("keep_id", "n_copies", F.coalesce("hit", F.lit(False)).alias("collided"))


def redundant(rows: DataFrame, id_col: str = "ext_id", content_col: str = "content", fold: bool = False) -> DataFrame:
    """``keep_id, dup_id`` for every row that repeats a record under another id.

    Forms are worked out once and kept as hashes. Only records with copies are joined back to their rows, on the hash; a
    hot record's rows are split by the adaptive skew join, as nothing has to be gathered per record.
    """
    keys = stash(keyed(rows, id_col, content_col, fold), "keys")
    groups = keys.groupBy(KEY).agg(F.min("id").alias("keep_id"), F.max("id").alias("last_id")).where("last_id > keep_id").drop("last_id")
    return keys.join(groups, KEY).where("id > keep_id").select("keep_id", F.col("id").alias("dup_id")).distinct()
