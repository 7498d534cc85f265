"""Command line: python -m setweave COMMAND ... (see --help of each command).

Pages are a folder of page files, or a parquet table with ``doc_id`` and ``text``. Seeds are arguments (``_`` is a space,
``a::b`` a pair) or, after ``@``, a file with one seed per line.
"""

from __future__ import annotations

import argparse
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.operators import category, entities, expansion, patterns
from setweave.runtime import session
from setweave.sources import compaction, pages, sinks


def read_seeds(given: list[str]) -> list[expansion.Seed]:
    """Seeds of arguments and files; blank lines are skipped."""
    lines = [line for g in given for line in (Path(g[1:]).read_text(encoding="utf-8").splitlines() if g.startswith("@") else [g.replace("_", " ")])]
    cut = [tuple(x.strip() for x in line.split("::", 1)) for line in lines if line.strip()]
    return [c if len(c) == 2 else c[0] for c in cut]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("doc_id", "text")
    return pages.scan(spark, path).select(F.col("path").alias("doc_id"), "text")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="setweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("expand", "iterate", "category"):
        c = commands.add_parser(name)
        c.add_argument("pages")
        c.add_argument("seeds", nargs="+", help="seeds; for category its name")
        c.add_argument("--feature", default="WLW")
        c.add_argument("--lang", default="un")
        c.add_argument("--bracket", type=int, default=-1)
        c.add_argument("--level", type=int, default=0)
        c.add_argument("--noisy", action="store_true")
        c.add_argument("--top", type=int, default=100)
        c.add_argument("--xml", help="also write the list there")
        c.add_argument("--policy", default="ISS_UNSUPERVISED")
        c.add_argument("--rounds", type=int, default=3)
    c = commands.add_parser("index")
    c.add_argument("pages")
    c.add_argument("out")
    c = commands.add_parser("search")
    c.add_argument("pages")
    c.add_argument("phrases", nargs="+")
    c.add_argument("--top", type=int, default=100)
    c = commands.add_parser("compact")
    c.add_argument("listing", help="parquet table of files with their contents")
    c.add_argument("out")
    a = parser.parse_args(arguments)
    spark = SparkSession.getActiveSession() or session()

    if a.command == "index":
        pages.postings(read_pages(spark, a.pages)).write.mode("overwrite").parquet(a.out)
    elif a.command == "search":
        pages.search(read_pages(spark, a.pages), [(0, p) for p in a.phrases], a.top).orderBy("rank").show(a.top, False)
    elif a.command == "compact":
        print(compaction.consolidate(spark, spark.read.parquet(a.listing), a.out))
    else:
        docs = read_pages(spark, a.pages)
        how = expansion.Expansion(replace(patterns.Settings(), lang=a.lang, bracket=a.bracket, html_level=a.level), a.feature, a.noisy)
        if a.command == "category":
            found = category.members(spark, docs, docs, " ".join(a.seeds), a.lang if a.lang in category.PHRASES else "en", how)
            entities.top(found, a.top).show(a.top, False)
            return
        seeds = read_seeds(a.seeds)
        found = expansion.expand(docs, seeds, how) if a.command == "expand" else expansion.iterate(docs, expansion.SeedSelector(a.policy, [expansion.name_of(s) for s in seeds]), a.rounds, how)
        entities.ranked(found, a.top, by="score").select("rank", "entity", "score", "weight", "is_seed").show(a.top, False)
        if a.xml:
            sinks.write_result(found, a.xml)


if __name__ == "__main__":
    main()
