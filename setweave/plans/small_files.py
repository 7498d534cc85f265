"""Queries of problem 1: consolidating the tiny files of wrapper_files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.sources import compaction as C


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the consolidated store, read back from what was written."""
    store = C.consolidate(spark, spark.read.parquet(f"{sf_dir}/wrapper_files.parquet"))
    return C.read_store(spark, store).select("file_id", "line_no")


#: A small target, with which the test tables come out in many groups as large ones do with the usual one.
SMALL_TARGET = 64 * 1024


def p1_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan alone: what each group of files holds."""
    manifest = C.freeze_manifest(spark.read.parquet(f"{sf_dir}/wrapper_files.parquet"))
    return C.plan_groups(manifest).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").cast("bigint").alias("n_bytes"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of many groups: how many files and records each output file holds."""
    store = C.consolidate(spark, spark.read.parquet(f"{sf_dir}/wrapper_files.parquet"), target_bytes=SMALL_TARGET)
    return C.read_store(spark, store).groupBy("group_id").agg(F.count_distinct("file_id").alias("n_files"), F.count(F.lit(1)).alias("n_records"))


_FILES = """
spelled AS (SELECT file_id, payload, modified_at, CASE WHEN size_bytes > 0 THEN size_bytes ELSE coalesce(strlen(payload), 0) END AS size_bytes,
    regexp_replace(regexp_replace(regexp_replace(url, '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '[^/]+/\\.\\./', '', 'g') AS path
  FROM wrapper_files WHERE file_id IS NOT NULL AND url IS NOT NULL),
kept AS (SELECT path, min(file_id) AS file_id, arg_max(payload, (modified_at, -file_id)) FILTER (payload IS NOT NULL) AS payload,
    arg_max(size_bytes, (modified_at, -file_id)) AS size_bytes
  FROM spelled WHERE regexp_matches(path, '\\.(txt|html|htm)$') GROUP BY path),
lines AS (SELECT file_id, unnest(string_split(replace(payload, chr(13) || chr(10), chr(10)), chr(10))) AS line,
    unnest(range(1, len(string_split(replace(payload, chr(13) || chr(10), chr(10)), chr(10))) + 1)) AS line_no FROM kept),
records AS (SELECT file_id, CAST(line_no AS INTEGER) AS line_no FROM lines WHERE line_no > 1 AND contains(line, chr(9))),
placed AS (SELECT *, CAST('0x' || substr(md5(path), 1, 15) AS BIGINT) AS h FROM kept),
started AS (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY h, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_byte FROM placed)
"""

SQL = {
    "p1_found": f"WITH {_FILES} SELECT file_id, line_no FROM records",
    "p1_plan": f"WITH {_FILES} SELECT CAST(start_byte // {C.TARGET_BYTES} AS INTEGER) AS group_id, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM started GROUP BY 1",
    "p1_groups": f"""WITH {_FILES}
SELECT CAST(start_byte // {SMALL_TARGET} AS INTEGER) AS group_id, count(DISTINCT file_id) AS n_files, count(*) AS n_records FROM started JOIN records USING (file_id) GROUP BY 1""",
}

QUERIES = {"p1_found": p1_found, "p1_plan": p1_plan, "p1_groups": p1_groups}
