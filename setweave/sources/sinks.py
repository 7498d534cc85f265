"""Where results go: XML lists of entities, and saved patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.functions.text import escape_entities, escape_field
from setweave.operators.entities import ranked

MIN_GAIN, MIN_CONTEXT, MIN_SCORE = 0.5, 3, 0.01


def entity_xml(scored: DataFrame, most: int = 2000) -> DataFrame:
    """``rank, xml``: the first entities of a list as elements."""
    best = ranked(scored, most, by="score")
    attributes = F.struct(F.col("rank").alias("_rank"), F.round("score", 8).alias("_score"), F.round("weight", 6).alias("_weight"), F.col("entity").alias("_VALUE"))
    return best.select("rank", F.to_xml(attributes, {"rowTag": "entity", "indent": ""}).alias("xml"))


def write_result(scored: DataFrame, path: str, most: int = 2000) -> None:
    """The first entities as one XML document per part file, in order."""
    best = ranked(scored, most, by="score")
    rows = best.select(F.col("rank").alias("_rank"), F.col("score").alias("_score"), F.col("weight").alias("_weight"), F.col("entity").alias("name"))
    rows.coalesce(1).sortWithinPartitions("_rank").write.option("rootTag", "entities").option("rowTag", "entity").format("xml").save(path)


def _element(name: str, value: Column, **attributes: Column) -> Column:
    parts = [F.concat(F.lit(f' {k}="'), escape_entities(v.cast("string")), F.lit('"')) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *parts, F.lit(">"), escape_entities(value.cast("string")), F.lit(f"</{name}>"))


def response_lines(scored: DataFrame, seeds: Sequence[str], extract_lang: str, fetch_lang: str | None = None, saved: DataFrame | None = None, most: int = 2000, elapsed_ms: int = 0) -> DataFrame:
    """``part, pos, line``: the result of an expansion as one XML document: its seeds and languages, the first entities
    with rank, score and weight, and the patterns worth saving (``saved``: doc, wrapper, entity) if given.

    Lines are in the order of part and pos; patterns stay rows, there may be very many.
    """
    spark, text = scored.sparkSession, lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    best = ranked(scored, most, by="score")
    setting = ["<setting>", "<seeds>", *[f"<seed>{text(s)}</seed>" for s in seeds], "</seeds>", f"<extract-language>{extract_lang}</extract-language>", f"<fetch-language>{fetch_lang or extract_lang}</fetch-language>", "</setting>"]
    fixed = [(0, k, x) for k, x in enumerate([f'<response elapsedTimeInMS="{elapsed_ms}">', *setting])] + [(2, 0, "</entities>"), (5, 0, "</response>")]
    count = scored.agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("part"), F.lit(0).alias("pos"), F.concat(F.lit('<entities numEntities="'), F.col("n").cast("string"), F.lit('">')).alias("line"))
    each = best.select(F.lit(1).alias("part"), F.col("rank").cast("int").alias("pos"), _element("entity", F.col("entity"), rank=F.col("rank"), score=F.round("score", 8), weight=F.round("weight", 6)).alias("line"))
    out = spark.createDataFrame(fixed, "part int, pos int, line string").unionByName(count).unionByName(each)
    if saved is not None:
        rows = saved.select(F.lit(4).alias("part"), F.lit(0).alias("pos"), _element("wrapper", F.col("entity"), page=F.col("doc"), context=F.col("wrapper")).alias("line"))
        frame = spark.createDataFrame([(3, 0, "<wrappers>"), (4, 1, "</wrappers>")], "part int, pos int, line string")
        out = out.unionByName(frame).unionByName(rows)
    return out


def write_response(lines: DataFrame, path: str) -> None:
    """Write the lines of ``response_lines`` in order, as one text."""
    lines.repartitionByRange(1, "part", "pos", "line").sortWithinPartitions("part", "pos", "line").select("line").write.text(path)


def worthwhile(facts: DataFrame, scored: DataFrame, n_seeds: int, context: str = "ctx_len") -> DataFrame:
    """``doc, wrapper, entity, score``: contents worth saving (by score), of patterns whose contents' scores exceed the
    number of seeds and whose contexts aren't too short."""
    known = facts.join(scored.select("entity", "score"), "entity")
    gain = known.groupBy("doc", "wrapper").agg((F.sum("score") - n_seeds).alias("gain"), F.max(context).alias("n")).where((F.col("gain") >= MIN_GAIN) & (F.col("n") >= MIN_CONTEXT))
    return known.join(gain.select("doc", "wrapper"), ["doc", "wrapper"], "left_semi").where(F.col("score") >= MIN_SCORE).select("doc", "wrapper", "entity", "score")


def saved_lines(patterns: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, line``: a header line per pattern, then a line per content, in the form that the consolidator reads."""
    c = F.explode("contents").alias("c")
    body = patterns.select(id_col, "left", "right", c).select(id_col, F.concat_ws("\t", escape_field(F.col("left")), escape_field(F.concat_ws("::", "c.arg1", "c.arg2")), escape_field(F.col("right"))).alias("line"), F.lit(1).alias("k"), "left", "right")
    head = patterns.select(id_col, F.concat_ws("\t", F.col(id_col).cast("string"), escape_field(F.concat("left", F.lit("[...]"), "right"))).alias("line"), F.lit(0).alias("k"), "left", "right")
    return head.unionByName(body)
