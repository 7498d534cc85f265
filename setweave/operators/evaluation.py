"""Evaluation of ranked lists against gold lists, question answering by lists, and small tools around them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setweave.functions.text import language_pattern
from setweave.operators.entities import numbered
from setweave.operators.expansion import _order

OPTIONAL = "[.·・-]"


def gold_of_lines(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """``keys, pos, synonym``: the TAB-separated synonyms of each line, empty ones left out."""
    return lines.select(*keys, F.posexplode(F.split(line, "\t")).alias("pos", "synonym")).withColumn("synonym", F.trim("synonym")).where("synonym <> ''")


def answer_patterns(lines: DataFrame, line: str) -> DataFrame:
    """``qid, pattern``: lines of a question's number and a regular expression."""
    parts = F.split(F.trim(line), r"\s+", 2)
    return lines.where(F.size(parts) == 2).select(parts[0].alias("qid"), parts[1].alias("pattern"))


def true_answers(lines: DataFrame, line: str = "line", pos: str = "pos", by: Sequence[str] = ()) -> DataFrame:
    """``by, qid, answer``: a file of answers, where a line ``# N`` begins question N, ``Q:`` lines and blank ones are
    skipped, and an answer is what stands before the first comma. ``pos`` is the order of lines, ``by`` names the file."""
    text = F.trim(line)
    marked = lines.withColumn("_q", F.when(text.startswith("# "), F.trim(F.substring(text, F.lit(3), F.length(text)))))
    qid = F.last("_q", True).over(W.partitionBy(*by).orderBy(pos))
    rest = marked.withColumn("qid", qid).where(F.col("_q").isNull() & (text != "") & ~text.startswith("Q:"))
    return rest.select(*by, "qid", F.trim(F.split(text, ",")[0]).alias("answer"))


def run_answers(lines: DataFrame, line: str = "line") -> DataFrame:
    """``qid, answer``: lines of a system's run, of four fields (question, any two, answer); lines of Q0, empty answers
    (``NIL``) and single characters are skipped, quotes and a last comma go."""
    f = F.split(line, r"\s+", 4)
    raw = lines.where(F.size(f) == 4).select(f[0].alias("qid"), f[1].alias("second"), F.trim(f[3]).alias("answer")).where("second <> 'Q0' AND answer <> 'NIL' AND length(answer) <> 1")
    return raw.select("qid", F.lower(F.regexp_replace(F.trim(F.regexp_replace("answer", "[ _]+", " ")), "``|''|,$", "")).alias("answer"))


def question_files(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """``question, qid, focus, types, keywords, answers`` of questions' XML files beside their other columns; other files
    than those of list questions give no row. Keywords and answers are arrays of (value, weight), the greatest first."""
    root = "AnswerGenerator/RequestObject"
    path = lambda x: F.expr(f"xpath(`{xml}`, '/{x}')")
    one = lambda x: F.expr(f"xpath_string(`{xml}`, '/{x}')")
    weighed = lambda v, w: F.reverse(F.array_sort(F.transform(F.arrays_zip(v.alias("value"), w.alias("weight")), lambda x: F.struct(x["weight"].cast("double").alias("weight"), x["value"].alias("value")))))
    turned = lambda a: F.transform(a, lambda x: F.struct(x["value"].alias("value"), x["weight"].alias("weight")))
    term, fill = f"{root}/Keywords/Keyword/Term", "AnswerGenerator/RequestFillSet/RequestFill/Answer"
    keep = [c for c in pages.columns if c != xml]
    types = F.flatten(F.transform(path(f"{root}/AnswerTypeInfo/AnswerType/text()"), lambda t: F.split(t, "->")))
    rows = pages.where(one(f"{root}/Question/@type") == "list").select(
        *keep, one(f"{root}/Question").alias("question"), one(f"{root}/Question/@trecID").alias("qid"), one(f"{root}/AnswerTypeInfo/Focus").alias("focus"), types.alias("types"),
        turned(weighed(path(f"{term}/text()"), path(f"{term}/@relFrequency"))).alias("keywords"), turned(weighed(path(f"{fill}/text()"), path(f"{fill}/@confidence"))).alias("answers"),
    )
    first = F.transform("keywords", lambda x: x["value"])
    return rows.withColumn("keywords", F.filter("keywords", lambda x, i: F.array_position(first, x["value"]) == i + 1))


def gold_files(spark: SparkSession, folder: str, lang: str | None = None, suffix: str = ".txt") -> DataFrame:
    """``lang, name, gold_id, pos, synonym``: the gold lists of a folder with a folder for each language; a file is a list,
    a line an entity. ``gold_id`` counts the lines of a file from 0."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = text.select(F.url_decode(F.element_at(parts, -2)).alias("lang"), F.url_decode(F.element_at(parts, -1)).alias("name"), F.posexplode(F.split("value", "\r?\n")).alias("gold_id", "line"))
    named = named.withColumn("name", F.substring("name", F.lit(1), F.length("name") - len(suffix)))
    return gold_of_lines(named if lang is None else named.where(F.col("lang") == lang), ["lang", "name", "gold_id"], "line")


def top_answers(answers: DataFrame, k: int) -> DataFrame:
    """``qid, item, weight``: the ``k`` best answers of each question, as seeds of an expansion."""
    order = W.partitionBy("qid").orderBy(F.col("weight").desc(), "item")
    return answers.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def hints(keywords: DataFrame, k: int = 3) -> DataFrame:
    """``qid, hint``: the ``k`` weightiest keywords of each question (qid, keyword, weight), the least of them first."""
    order = W.partitionBy("qid").orderBy(F.col("weight").desc(), "keyword")
    best = keywords.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    return best.groupBy("qid").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_k", "keyword")))), lambda x: x["keyword"]), " ").alias("hint"))


def synonyms(name: Column) -> Column:
    """What a gold entity's name may be written as: lower-cased, hyphens as spaces; with and without optional characters;
    English plurals and article where there is a Latin letter."""
    s = F.trim(F.replace(F.lower(name), F.lit("-"), F.lit(" ")))
    inner = s.rlike(rf"(?s)^.+{OPTIONAL}.+\z")
    without = F.when(inner, F.trim(F.regexp_replace(s, OPTIONAL, "")))
    spaced = F.when(inner, F.trim(F.regexp_replace(F.regexp_replace(s, OPTIONAL, " "), r"\s+", " ")))
    latin, y = s.rlike("[a-zA-Z]"), s.endswith("y")
    ies = F.when(latin & y, F.concat(F.substring(s, F.lit(1), F.length(s) - 1), F.lit("ies")))
    plain = [F.when(latin & ~y, c) for c in (F.concat(s, F.lit("s")), F.concat(s, F.lit("es")), F.concat(F.lit("the "), s))]
    return F.array_distinct(F.filter(F.array(s, without, spaced, ies, *plain), lambda x: x.isNotNull() & (x != "")))


def mark(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``ranked`` (list, entity, rank, ...) with ``correct``: 0 for what isn't in ``gold(list, gold_id, synonym)``, 1 for the
    first of a gold entity, 2 for its repetitions. A name of two gold entities counts for the smaller id."""
    known = gold.groupBy("list", F.col("synonym").alias("entity")).agg(F.min("gold_id").alias("gold_id"))
    joined = ranked.join(known, ["list", "entity"], "left")
    alone = F.when(F.col("gold_id").isNull(), F.col("rank"))  # what isn't gold isn't one group
    first = F.row_number().over(W.partitionBy("list", "gold_id", alone).orderBy("rank"))
    return joined.withColumn("correct", F.when(F.col("gold_id").isNull(), 0).when(first == 1, 1).otherwise(2)).drop("gold_id")


#: Ranks of a list that one task takes running sums over.
PIECE = 1 << 16


def precision_recall(marked: DataFrame, n_gold: DataFrame, piece: int = PIECE) -> DataFrame:
    """``list, rank, precision, recall, f1`` along each list: hits of any synonym to rank, first hits to gold entities.

    ``rank`` counts from 1 without gaps. Sums run over pieces of ``piece`` ranks, and go on from the sums of those before.
    """
    hit, new = F.when(F.col("correct") > 0, 1).otherwise(0), F.when(F.col("correct") == 1, 1).otherwise(0)
    placed = marked.withColumn("_piece", F.floor((F.col("rank") - 1) / piece))
    before = W.partitionBy("list").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy("list", "_piece").agg(F.sum(hit).alias("_h"), F.sum(new).alias("_f"))
    sums = sums.select("list", "_piece", F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_hits"), F.coalesce(F.sum("_f").over(before), F.lit(0)).alias("_firsts"))
    along = W.partitionBy("list", "_piece").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    run = placed.withColumn("_h", F.sum(hit).over(along)).withColumn("_f", F.sum(new).over(along)).join(sums, ["list", "_piece"])
    out = run.withColumn("precision", (F.col("_hits") + F.col("_h")) / F.col("rank")).withColumn("firsts", F.col("_firsts") + F.col("_f")).drop("_piece", "_h", "_f", "_hits", "_firsts")
    out = out.join(n_gold, "list").withColumn("recall", F.col("firsts") / F.col("n_gold"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def mean_average_precision(measured: DataFrame) -> DataFrame:
    """``list, map``: precision at each first hit, over the gold entities."""
    return measured.groupBy("list").agg((F.sum(F.when(F.col("correct") == 1, F.col("precision")).otherwise(0.0)) / F.max("n_gold")).alias("map"))


def best_f1(measured: DataFrame, score: str = "score") -> DataFrame:
    """``list, f1, precision, recall, score, rank`` where F1 is greatest, earliest."""
    best = F.max(F.struct("f1", (-F.col("rank")).alias("minus_rank"), "precision", "recall", score)).alias("b")
    return measured.groupBy("list").agg(best).select("list", "b.f1", "b.precision", "b.recall", F.col(f"b.{score}").alias("score"), (-F.col("b.minus_rank")).alias("rank"))


def at_threshold(measured: DataFrame, threshold: float = 0.8, score: str = "score") -> DataFrame:
    """``list, precision, recall, f1, rank`` at the last entity whose score reaches ``threshold``."""
    last = F.max(F.struct("rank", "precision", "recall", "f1")).alias("b")
    return measured.where(F.col(score) >= threshold).groupBy("list").agg(last).select("list", "b.*")


def at_rank(marked: DataFrame, n_gold: DataFrame, limit: float, score: str = "score") -> DataFrame:
    """Precision, recall and F1 of what is at least ``limit`` (a score, or from 1 on a rank); repetitions don't count."""
    chosen = marked.where(F.col("rank") <= limit if limit >= 1 else F.col(score) >= limit).where("correct < 2")
    got = chosen.groupBy("list").agg(F.sum("correct").alias("hits"), F.count(F.lit(1)).alias("n"))
    out = got.join(n_gold, "list").select("list", (F.col("hits") / F.col("n")).alias("precision"), (F.col("hits") / F.col("n_gold")).alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


# --- answers to questions: tables qid, item, weight ---


def answer_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items of both lists, whatever their case, weights multiplied."""
    one = a.select("qid", F.lower("item").alias("item"), "weight")
    two = b.select("qid", F.lower("item").alias("item"), F.col("weight").alias("other"))
    return one.join(two, ["qid", "item"]).select("qid", "item", (F.col("weight") * F.col("other")).alias("weight"))


def answer_union(a: DataFrame, b: DataFrame, default: float = 1e-3) -> DataFrame:
    """Items of either list: weights multiplied, ``default`` where a list hasn't got it."""
    one = a.select("qid", F.lower("item").alias("item"), F.col("weight").alias("x"))
    two = b.select("qid", F.lower("item").alias("item"), F.col("weight").alias("y"))
    return one.join(two, ["qid", "item"], "full").select("qid", "item", (F.coalesce("x", F.lit(default)) * F.coalesce("y", F.lit(default))).alias("weight"))


def normalize_answers(a: DataFrame) -> DataFrame:
    """Weights to the greatest of the question."""
    return a.join(a.groupBy("qid").agg(F.max("weight").alias("m")), "qid").select("qid", "item", (F.col("weight") / F.col("m")).alias("weight"))


def answer_top(a: DataFrame, share: float) -> DataFrame:
    """Items of at least ``share`` of the question's greatest weight."""
    return normalize_answers(a).where(F.col("weight") >= share)


def match_answers(answers: DataFrame, patterns: DataFrame) -> DataFrame:
    """``qid, item, weight, rank, correct``: in the order of a question's list, an answer is right if it matches one of its
    patterns in full, whatever the case, that no answer before has used; of several it uses the first by name.

    Ranks come from range pieces. Of the answers that match a pattern only the first few, as many as the question has
    patterns, can be the one that uses it, so no more than that come together for a question.
    """
    ranked = numbered(answers.select("qid", "item", "weight"), ["qid"], order=[F.col("weight").desc(), F.col("item")]).withColumn("rank", F.col("rank").cast("int"))
    wanted = patterns.select("qid", "pattern").distinct()
    wanted = wanted.join(wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("most")), "qid")
    hits = ranked.join(wanted, "qid").where(F.expr("item RLIKE concat('(?is)^(?:', pattern, ')\\\\z')"))
    nth = F.row_number().over(W.partitionBy("qid", "pattern").orderBy("rank"))
    few = hits.withColumn("nth", nth).where("nth <= most").select("qid", "rank", "pattern")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        used, right = set(), []
        for rank, group in rows.sort_values(["rank", "pattern"]).groupby("rank", sort=True):
            free = next((p for p in group.pattern if p not in used), None)
            if free is not None:
                used.add(free)
                right.append(rank)
        return pd.DataFrame({"qid": [rows.qid.iloc[0]] * len(right), "rank": np.array(right, "int32")})

    right = few.groupBy("qid").applyInPandas(walk, "qid string, rank int").withColumn("hit", F.lit(True))
    return ranked.join(right, ["qid", "rank"], "left").select("qid", "item", "weight", "rank", F.coalesce("hit", F.lit(False)).alias("correct"))


def rank_metrics(judged: DataFrame, n_gold: DataFrame) -> DataFrame:
    """``qid, avg_precision, best_f1, best_rank`` of judged answers (qid, rank, correct)."""
    along = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    c = F.col("correct").cast("int")
    run = judged.withColumn("hits", F.sum(c).over(along)).join(n_gold, "qid")
    f1 = 2 * F.col("hits") / (F.col("rank") + F.col("n_gold"))
    run = run.withColumn("f1", f1)
    best = F.max(F.struct("f1", (-F.col("rank")).alias("r"))).alias("b")
    ap = F.sum(F.when(F.col("correct"), F.col("hits") / F.col("rank")).otherwise(0.0)) / F.max("n_gold")
    return run.groupBy("qid").agg(ap.alias("avg_precision"), best).select("qid", "avg_precision", F.col("b.f1").alias("best_f1"), (-F.col("b.r")).alias("best_rank"))


def threshold_sweep(judged: DataFrame, n_gold: DataFrame, steps: int = 10_000) -> DataFrame:
    """``threshold, precision, recall, f1``: means over all questions at each of ``steps`` thresholds from 0 to 1.

    An answer counts at all thresholds up to its weight; as the counts only change there, they are aggregated by step
    and summed along the steps, which doesn't multiply answers by thresholds.
    """
    at = judged.withColumn("step", F.least(F.floor(F.col("weight") * steps), F.lit(steps)).cast("int")).where("step >= 0")
    by = at.groupBy("qid", "step").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("hits"))
    down = W.partitionBy("qid").orderBy(F.col("step").desc()).rowsBetween(W.unboundedPreceding, 0)
    total = by.select("qid", "step", F.sum("n").over(down).alias("n"), F.sum("hits").over(down).alias("hits"))
    until = total.withColumn("after", F.coalesce(F.lag("step").over(W.partitionBy("qid").orderBy("step")), F.lit(-1))).join(n_gold, "qid")
    p, r = F.col("hits") / F.col("n"), F.col("hits") / F.col("n_gold")
    piece = until.select(F.col("after").alias("from_"), F.col("step").alias("to_"), p.alias("p"), r.alias("r"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f"))
    # a piece holds from the step after the one below it up to its own: its values are added there and taken away after
    edge = F.explode(F.array(F.struct((F.col("from_") + 1).alias("step"), F.col("p"), F.col("r"), F.col("f")), F.struct((F.col("to_") + 1).alias("step"), (-F.col("p")).alias("p"), (-F.col("r")).alias("r"), (-F.col("f")).alias("f")))).alias("e")
    change = piece.select(edge).groupBy("e.step").agg(F.sum("e.p").alias("p"), F.sum("e.r").alias("r"), F.sum("e.f").alias("f"))
    grid = judged.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    up = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    questions = n_gold.agg(F.count(F.lit(1)).alias("q"))
    mean = lambda c: (F.sum(F.coalesce(c, F.lit(0.0))).over(up) / F.col("q"))
    return grid.join(change, "step", "left").crossJoin(F.broadcast(questions)).select((F.col("step") / steps).alias("threshold"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))


def folds(qid: Column, k: int = 5, seed: int = 0) -> Column:
    """A repeatable fold of each question."""
    return F.pmod(F.xxhash64(F.lit(seed), qid), F.lit(k)).cast("int")


def cross_validated(judged: DataFrame, n_gold: DataFrame, k: int = 5, seed: int = 0, steps: int = 1000) -> DataFrame:
    """``fold, threshold, f1``: the best threshold of all other folds, and the mean F1 it gives on the fold."""
    own, gold = judged.withColumn("fold", folds(F.col("qid"), k, seed)), n_gold.withColumn("fold", folds(F.col("qid"), k, seed))
    out = None
    for i in range(k):
        rest = threshold_sweep(own.where(F.col("fold") != i).drop("fold"), gold.where(F.col("fold") != i).drop("fold"), steps)
        best = rest.agg(F.max(F.struct(F.round("f1", 12), "threshold")).alias("b")).select("b.threshold")
        test = threshold_sweep(own.where(F.col("fold") == i).drop("fold"), gold.where(F.col("fold") == i).drop("fold"), steps)
        row = test.join(best, "threshold").select(F.lit(i).alias("fold"), "threshold", "f1")
        out = row if out is None else out.unionByName(row)
    return out


def hybrid(method: str, own: DataFrame, other: DataFrame, default: float = 1e-3) -> DataFrame:
    """One list from a system's answers and an expansion's: either of them, what both have, or all."""
    if method == "OWN":
        return own
    if method == "OTHER":
        return other
    if method == "INTERSECT":
        return answer_intersect(own, other)
    if method == "UNION":
        return answer_union(own, other, default)
    if method == "METHOD1":  # what one list lacks doesn't lessen the other's weight
        return answer_union(own, other, 1.0)
    raise ValueError(f"no method {method}")


# --- tools ---


def prefix_counts(words: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """``prefix, n`` of all prefixes of counted words, the empty one too."""
    each = F.explode(F.transform(F.sequence(F.lit(0), F.length(word)), lambda k: F.substring(word, F.lit(1), k))).alias("prefix")
    return words.select(each, F.col(n).alias("n")).groupBy("prefix").agg(F.sum("n").alias("n"))


def prefix_likelihood(words: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """``word, log_likelihood``: the sum over a word's letters of how likely each is after the ones before it."""
    counts = prefix_counts(words, word, n)
    steps = words.select(F.col(word).alias("word"), F.explode(F.sequence(F.lit(1), F.length(word))).alias("k")).where(F.length("word") > 0)
    child = steps.select("word", F.substring("word", F.lit(1), F.col("k")).alias("prefix"), F.substring("word", F.lit(1), F.col("k") - 1).alias("parent"))
    parents = counts.select(F.col("prefix").alias("parent"), F.col("n").alias("m"))
    return child.join(counts, "prefix").join(parents, "parent").groupBy("word").agg(F.sum(F.log(F.col("n") / F.col("m"))).alias("log_likelihood"))


def likely_strings(words: DataFrame, threshold: float, prefixes: bool = False, word: str = "word", n: str = "n") -> DataFrame:
    """``string, probability``: the strings of which at least the share ``threshold`` of all counted words begins with
    them; with ``prefixes`` the longest beginnings of which that holds, whether words or not."""
    counts = prefix_counts(words, word, n)
    total = counts.where("prefix = ''").select(F.col("n").alias("_total"))
    likely = counts.crossJoin(F.broadcast(total)).select(F.col("prefix").alias("string"), (F.col("n") / F.col("_total")).alias("probability")).where(F.col("probability") >= threshold)
    if not prefixes:
        return likely.join(words.select(F.col(word).alias("string")).distinct(), "string", "left_semi")
    longer = likely.where("string <> ''").select(F.substring("string", F.lit(1), F.length("string") - 1).alias("string")).distinct()
    return likely.where("string <> ''").join(longer, "string", "left_anti")


def string_counts(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", word: str = "word") -> DataFrame:
    """``id_col, word, n``: how often each word stands in each text, within words too and overlapping ones each.

    Of a few words those of one length are looked for at once, by one expression that takes no text, so that every place
    counts. Of many, texts are cut into all pieces of the lengths that words have, which meet the words by an equi-join.
    """
    wanted = words.select(F.col(word).alias("word")).where("word <> ''").distinct()
    few = [r.word for r in wanted.limit(FEW_WORDS + 1).collect()]
    if len(few) <= FEW_WORDS:
        by: dict[int, list[str]] = {}
        for w in few:
            by.setdefault(len(w), []).append(w)
        found = [F.regexp_extract_all(text_col, F.lit(f"(?=({'|'.join(map(re.escape, sorted(ws)))}))"), F.lit(1)) for ws in by.values()] or [F.array().cast("array<string>")]
        pieces = docs.select(id_col, F.explode(F.flatten(F.array(*found))).alias("word"))
        return pieces.groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    lengths = sorted(r.n for r in wanted.select(F.length("word").alias("n")).distinct().collect())
    sized = docs.select(id_col, F.col(text_col).alias("_t"), F.explode(F.array(*map(F.lit, lengths))).alias("_n")).where(F.length("_t") >= F.col("_n"))
    pieces = sized.select(id_col, F.explode(F.transform(F.sequence(F.lit(1), F.length("_t") - F.col("_n") + 1), lambda i: F.substring("_t", i, F.col("_n")))).alias("word"))
    return pieces.join(wanted, "word", "left_semi").groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))


#: Words that one expression per length looks for.
FEW_WORDS = 1000


def any_of_pattern(words: Sequence[str]) -> str:
    """A regular expression that one of the words matches in full, with common beginnings written once."""

    def group(rest: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for w in rest:
            if w:
                by.setdefault(w[0], []).append(w[1:])
        inner = "|".join(re.escape(c) + group(tails) for c, tails in sorted(by.items()))
        return "" if not by else f"(?:{inner})" + "?" * ("" in rest)

    return group(sorted(set(words)))


def with_dictionary(relations: DataFrame, dictionary: DataFrame, line: str = "line", lang: str = "en") -> DataFrame:
    """``relation``: the pairs ``a::b`` of which b is in a dictionary, and a pair for each acronym that it explains.

    A dictionary's line begins with a name in the language; ``(ABC)`` at its end is the name's acronym.
    """
    found = dictionary.select(F.trim(F.regexp_extract(line, language_pattern(lang), 0)).alias("name"), F.regexp_extract(line, r"\(([A-Z]+)\)$", 1).alias("short")).where("name <> ''")
    known = relations.where(F.col("relation").contains("::")).select("relation", F.split("relation", "::")[1].alias("name")).join(found.select("name").distinct(), "name", "left_semi").select(F.trim("relation").alias("relation"))
    return known.unionByName(found.where("short <> ''").select(F.concat_ws("::", "short", "name").alias("relation"))).distinct()


def relation_cross(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, relation``: pairs ``a::b`` of the names that two gold lists have for the same entity."""
    return a.select(key, F.col("name").alias("x")).join(b.select(key, F.col("name").alias("y")), key).select(key, F.concat_ws("::", "x", "y").alias("relation"))


def not_functional(pairs: DataFrame) -> DataFrame:
    """``arg1, n``: first parts of pairs that have more than one second part."""
    return pairs.where("arg1 IS NOT NULL AND arg2 IS NOT NULL").groupBy("arg1").agg(F.count_distinct("arg2").alias("n")).where("n > 1")


class VotedPerceptron:
    """A voted perceptron over dense vectors, trained on a bounded sample; ``predict`` is a vectorized function of arrays."""

    def __init__(self, epochs: int = 3, most_rows: int = 100_000):
        self.epochs, self.most_rows = epochs, most_rows
        self.vectors, self.votes = np.zeros((0, 0)), np.zeros(0)

    def fit(self, rows: Iterable[tuple[Sequence[float], int]]) -> VotedPerceptron:
        data = [(np.asarray(x, float), 1 if y > 0 else -1) for x, y in rows][: self.most_rows]
        w, votes, kept = np.zeros(len(data[0][0]) if data else 0), 0, []
        for _ in range(self.epochs):
            for x, y in data:
                if y * float(w @ x) > 0:
                    votes += 1
                else:
                    kept.append((w.copy(), votes))
                    w, votes = w + y * x, 1
        kept.append((w, votes))
        self.vectors, self.votes = np.array([k for k, _ in kept]), np.array([v for _, v in kept], float)
        return self

    def decide(self, x: np.ndarray) -> np.ndarray:
        return np.sign(np.sign(np.atleast_2d(x) @ self.vectors.T) @ self.votes)

    def predict(self, c: Column) -> Column:
        model = self

        from pyspark.sql.types import IntegerType

        @F.pandas_udf(IntegerType())
        def run(v: pd.Series) -> pd.Series:
            return pd.Series(model.decide(np.stack(v.to_numpy())).astype("int32")) if len(v) else pd.Series([], dtype="int32")

        return run(c)


def trial_means(trials: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means over trials; a trial without a result doesn't count."""
    return trials.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.count(metrics[0]).alias("n_trials"))


def shuffled_trial(names: Sequence[str], k: int, trial: int) -> list[str]:
    """The seeds of a trial: repeatable, different from trial to trial."""
    return sorted(names, key=lambda n: _order(trial * 7919 + 13, n))[:k]

