"""Web archive records and the lines of a batch search's response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions.text import page_title


def read(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the records of archive files, cut where a record's version line begins."""
    return spark.read.text(path, lineSep="WARC/").select(F.concat(F.lit("WARC/"), F.col("value")).alias("record")).where("record <> 'WARC/'")


def parse(records: DataFrame, record: str = "record") -> DataFrame:
    """``uri, content_length, body, title`` with the other columns. A record has its own header, the response's header
    and the body, each ended by a blank line; the declared length is reported, not trusted."""
    keep = [c for c in records.columns if c != record]
    r = F.regexp_replace(F.col(record), "\r\n", "\n")
    field = lambda name: F.nullif(F.regexp_extract(r, rf"(?im)^{name}:[ \t]*(.*)$", 1), F.lit(""))
    parts = F.split(r, "\n\n", 3)
    http = parts[1].startswith("HTTP/")
    body = F.when(http, F.try_element_at(parts, F.lit(3))).otherwise(F.concat_ws("\n\n", parts[1], F.try_element_at(parts, F.lit(3))))
    out = records.select(*keep, field("WARC-Target-URI").alias("uri"), field("Content-Length").try_cast("int").alias("content_length"), body.alias("body"))
    return out.withColumn("title", page_title(F.col("body")))


def record_of(uri: Column, body: Column) -> Column:
    """A record of a page, as ``parse`` reads it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\nContent-Type: text/html\n\n"), body)
    return F.concat(F.lit("WARC/1.0\nWARC-Type: response\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\nContent-Length: "), F.length(http).cast("string"), F.lit("\n\n"), http)


def result_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``query_idx, docid, rank`` of a response's lines of six fields; other lines are skipped."""
    f = F.split(F.trim(line), r"\s+")
    return lines.where(F.size(f) == 6).select(f[0].try_cast("int").alias("query_idx"), f[2].alias("docid"), f[3].try_cast("int").alias("rank")).where("rank IS NOT NULL")


def phrase_query(phrase: Column) -> Column:
    """A quoted phrase in the batch search's language: an ordered window of its words, punctuation as spaces."""
    words = F.trim(F.regexp_replace(F.regexp_replace(phrase, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    return F.concat(F.lit("#1("), words, F.lit(")"))


def batch_document(queries: DataFrame, number: str = "number", text: str = "text", full_text: bool = True) -> DataFrame:
    """``pos, line``: a batch of queries as the parameter document that a search server takes, line by line in ``pos``."""
    each = queries.select(F.col(number).cast("bigint").alias("pos"), F.array(F.lit("<query>"), F.concat(F.lit("<number>"), F.col(number).cast("string"), F.lit("</number>")), F.concat(F.lit("<text>"), text, F.lit("</text>")), F.lit("</query>")).alias("lines"))
    body = each.select("pos", F.posexplode("lines").alias("k", "line")).select((F.col("pos") * 4 + F.col("k") + 1).alias("pos"), "line")
    ends = [(0, "<parameters>" + "<printDocuments>true</printDocuments>" * full_text), (2**62, "</parameters>")]
    return body.unionByName(queries.sparkSession.createDataFrame(ends, "pos bigint, line string"))
