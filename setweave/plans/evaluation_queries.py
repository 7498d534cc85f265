"""Queries of evaluation, question answering and the tools, over all lists, results and contents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setweave.functions import text as T
from setweave.operators import entities as E
from setweave.operators import evaluation as V
from setweave.operators import expansion as X
from setweave.plans.expansion_queries import SEEDS, TWO, pages
from setweave.plans.ranking_queries import FACTS, facts
from setweave.plans.text_queries import load, q
from setweave.runtime import scratch_path


def lists(spark: SparkSession, sf: str) -> DataFrame:
    """``list, entity, rank, score``: the scored lists as results, by pattern-length weight."""
    rows = load(spark, sf, "entity_scores").where("list_id IS NOT NULL AND entity IS NOT NULL AND wlw IS NOT NULL AND NOT isnan(wlw) AND abs(wlw) < 1e300")
    best = rows.groupBy(F.col("list_id").alias("list"), "entity").agg(F.max("wlw").alias("weight"))
    return E.numbered(best, ["list"]).withColumn("rank", F.col("rank").cast("int")).withColumn("score", F.col("weight") / 20).drop("weight")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """``list, gold_id, synonym``: entities that many documents have are right, with all synonyms of their names."""
    rows = load(spark, sf, "entity_scores").where("list_id IS NOT NULL AND entity IS NOT NULL AND edf >= 20")
    ids = rows.groupBy(F.col("list_id").alias("list"), "entity").agg(F.min("entity_id").alias("gold_id"))
    return ids.select("list", "gold_id", F.explode(V.synonyms(F.col("entity"))).alias("synonym"))


def n_gold(spark, sf) -> DataFrame:
    return gold(spark, sf).groupBy("list").agg(F.count_distinct("gold_id").alias("n_gold"))


def marked(spark, sf) -> DataFrame:
    return V.mark(lists(spark, sf), gold(spark, sf))


def measured(spark, sf) -> DataFrame:
    return V.precision_recall(marked(spark, sf), n_gold(spark, sf))


def _r(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 9))
    return df


def gold_synonyms(spark, sf):
    names = load(spark, sf, "extractions").where("content IS NOT NULL").select("content").distinct()
    return names.select("content", F.explode(V.synonyms(F.col("content"))).alias("synonym"))


def mark_correct(spark, sf):
    return marked(spark, sf).select("list", "entity", "correct")


def precision_recall(spark, sf):
    return _r(measured(spark, sf).select("list", "rank", "precision", "recall", "f1"), "precision", "recall", "f1")


def mean_avg_precision(spark, sf):
    return _r(V.mean_average_precision(measured(spark, sf)), "map")


def best_f1(spark, sf):
    return _r(V.best_f1(measured(spark, sf)), "f1", "precision", "recall", "score")


def metrics_at_threshold(spark, sf):
    return _r(V.at_threshold(measured(spark, sf), 0.25), "f1", "precision", "recall")


def pr_at_k(spark, sf):
    return _r(V.at_rank(marked(spark, sf), n_gold(spark, sf), 10), "f1", "precision", "recall")


def merge_eval(spark, sf):
    trials = V.mean_average_precision(measured(spark, sf)).withColumn("trial", F.pmod("list", F.lit(5)))
    return _r(V.trial_means(trials, ["trial"], ["map"]), "map")


def experiment_grid(spark, sf):
    """Mean average precision of every score as a ranker, over all lists, as one row per score and one of means."""
    out = None
    for feature in ("log_score", "cell_value", "wlw", "gww", "edf"):
        rows = load(spark, sf, "entity_scores").where(f"list_id IS NOT NULL AND entity IS NOT NULL AND {feature} IS NOT NULL AND NOT isnan({feature}) AND abs({feature}) < 1e300")
        best = rows.groupBy(F.col("list_id").alias("list"), "entity").agg(F.max(feature).cast("double").alias("weight"))
        ranked = E.numbered(best, ["list"])
        row = V.mean_average_precision(V.precision_recall(V.mark(ranked, gold(spark, sf)), n_gold(spark, sf))).select(F.lit(feature).alias("feature"), "map")
        out = row if out is None else out.unionByName(row)
    return out.rollup("feature").agg(F.round(F.avg("map"), 9).alias("map"), F.count(F.lit(1)).alias("n_lists")).withColumn("feature", F.coalesce("feature", F.lit("mean")))


# --- answers: the titles of a query's results against the entities of the lists ---


def _own(spark, sf) -> DataFrame:
    rows = load(spark, sf, "warc").where("query_idx IS NOT NULL AND title IS NOT NULL AND rank IS NOT NULL")
    return rows.groupBy(F.col("query_idx").cast("string").alias("qid"), F.lower("title").alias("item")).agg(F.max(1 / F.col("rank")).alias("weight"))


def _other(spark, sf) -> DataFrame:
    rows = load(spark, sf, "warc").where("query_idx IS NOT NULL AND title IS NOT NULL AND body IS NOT NULL")
    return rows.groupBy(F.col("query_idx").cast("string").alias("qid"), F.col("title").alias("item")).agg((F.max(F.length("body")) / 500).alias("weight"))


def answer_intersect(spark, sf):
    return _r(V.answer_intersect(_own(spark, sf), _other(spark, sf)), "weight")


def answer_union(spark, sf):
    return _r(V.answer_union(_own(spark, sf), _other(spark, sf)), "weight")


def answer_topk(spark, sf):
    return _r(V.answer_top(_other(spark, sf), 0.5), "weight")


def qa_hybrid(spark, sf):
    out = [V.hybrid(m, _own(spark, sf), _other(spark, sf)).select(F.lit(m).alias("method"), "qid", F.lower("item").alias("item"), "weight") for m in ("OWN", "OTHER", "INTERSECT", "UNION", "METHOD1")]
    return _r(reduce(DataFrame.unionByName, out), "weight")


def qa_seeds(spark, sf):
    """The two best answers of each question, as seeds."""
    return _r(V.top_answers(_own(spark, sf), 2), "weight")


def qa_hints(spark, sf):
    """Three hints of each question: the most frequent words of its titles."""
    word = F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("keyword")
    words = load(spark, sf, "warc").where("query_idx IS NOT NULL").select(F.col("query_idx").cast("string").alias("qid"), word).groupBy("qid", "keyword").agg(F.count(F.lit(1)).alias("weight"))
    return V.hints(words)


def _question_xml() -> Column:
    """A question's file made of an evaluation item."""
    text = T.escape_entities(F.regexp_replace("text", r"[\x00-\x1F]+", " "))
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    terms = F.array_join(F.transform(words, lambda w, i: F.concat(F.lit('<Keyword><Term relFrequency="'), (1 / (i + 2)).cast("string"), F.lit('">'), w, F.lit("</Term></Keyword>"))), "")
    answers = F.array_join(F.transform(words, lambda w, i: F.concat(F.lit('<RequestFill><Answer confidence="'), (i % 3).cast("string"), F.lit('">'), w, F.lit("</Answer></RequestFill>"))), "")
    kind = F.when(F.col("item_id") % 4 == 0, "factoid").otherwise("list")
    return F.concat(F.lit('<AnswerGenerator><RequestObject><Question type="'), kind, F.lit('" trecID="'), F.col("item_id").cast("string"), F.lit('">'), text, F.lit("</Question><AnswerTypeInfo><AnswerType>A-&gt;B</AnswerType><Focus>f</Focus></AnswerTypeInfo><Keywords>"), terms, F.lit("</Keywords></RequestObject><RequestFillSet>"), answers, F.lit("</RequestFillSet></AnswerGenerator>"))


def load_questions(spark, sf):
    """Questions' files, each made of an evaluation item: its keywords and answers, by weight."""
    found = V.question_files(load(spark, sf, "eval_items").select("item_id", _question_xml().alias("xml")))
    values = lambda c: F.array_join(F.transform(c, lambda x: x["value"]), "|")
    return found.select("item_id", "qid", "focus", F.array_join("types", "|").alias("types"), F.size("keywords").alias("n_keywords"), F.size("answers").alias("n_answers"), values("answers").alias("answers"))


def load_runs(spark, sf):
    """A system's run, of which every result is a line."""
    line = F.concat_ws(" ", "query_idx", F.when(F.col("rank") == 1, "Q0").otherwise("r"), "rank", "title")
    return V.run_answers(load(spark, sf, "warc").where("query_idx IS NOT NULL AND rank IS NOT NULL").select(line.alias("line")))


def load_answers(spark, sf):
    """A file of answers for each saved file: its first line is the question, the others are answers."""
    lines = load(spark, sf, "wrapper_files").select("file_id", F.posexplode(F.split("payload", "\r?\n")).alias("pos", "text"))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    line = F.when(F.col("pos") == 0, F.concat(F.lit("# "), F.col("file_id").cast("string"))).otherwise(text)
    return V.true_answers(lines.select("file_id", "pos", line.alias("line")), by=["file_id"])


def gold_discovery(spark, sf):
    """Gold lists found in a folder with a folder for each language: the documents of a language, as one list of lines."""
    folder = scratch_path(spark, "gold")
    rows = load(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.regexp_replace("text", r"[\r\n]+", " ").alias("line"))
    rows.repartition("lang").write.partitionBy("lang").text(folder)
    return V.gold_files(spark, folder).groupBy("lang").agg(F.count_distinct("name", "gold_id").alias("n_gold"), F.count(F.lit(1)).alias("n_synonyms")).withColumn("lang", F.replace("lang", F.lit("lang="), F.lit("")))


def _patterns(spark, sf) -> DataFrame:
    word = F.regexp_extract(F.lower("title"), r"^([a-z]+)", 1)
    return load(spark, sf, "warc").where("query_idx IS NOT NULL").select(F.col("query_idx").cast("string").alias("qid"), word.alias("w")).where("w <> ''").distinct().select("qid", F.concat("w", F.lit(".*")).alias("pattern"))


def match_answers(spark, sf):
    return V.match_answers(_own(spark, sf), _patterns(spark, sf)).select("qid", "item", "rank", "correct")


def _judged(spark, sf) -> DataFrame:
    """Answers of which those are right that begin with a vowel."""
    own = V.normalize_answers(_own(spark, sf))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.col("weight").desc(), "item"))
    return own.select("qid", "item", "weight", rank.alias("rank"), F.col("item").rlike("^[aeiou]").alias("correct"))


def _n_right(spark, sf) -> DataFrame:
    return _judged(spark, sf).groupBy("qid").agg((F.count_if("correct") + 1).alias("n_gold"))


def stat_metrics(spark, sf):
    return _r(V.rank_metrics(_judged(spark, sf), _n_right(spark, sf)), "avg_precision", "best_f1")


def threshold_sweep(spark, sf):
    return _r(V.threshold_sweep(_judged(spark, sf), _n_right(spark, sf)), "threshold", "precision", "recall", "f1")


def cv_threshold(spark, sf):
    return _r(V.cross_validated(_judged(spark, sf), _n_right(spark, sf)), "threshold", "f1")


def translation_accuracy(spark, sf):
    """How many pairs of contents read the same from either side: those of which the turned pair was extracted, too."""
    cut = F.split(F.lower("content"), "::", 2)
    pairs = load(spark, sf, "extractions").where(F.col("content").contains("::")).select(F.trim(cut[0]).alias("a"), F.trim(cut[1]).alias("b")).distinct()
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("hit")).distinct()
    return pairs.join(turned, ["a", "b"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_correct"))


def prefix_likelihood(spark, sf):
    words = facts(spark, sf).groupBy(F.col("entity").alias("word")).agg(F.sum("tf").alias("n")).where("n IS NOT NULL")
    return _r(V.prefix_likelihood(words), "log_likelihood")


def _word_counts(spark, sf) -> DataFrame:
    return facts(spark, sf).groupBy(F.col("entity").alias("word")).agg(F.sum("tf").alias("n")).where("n IS NOT NULL")


def likely_strings(spark, sf):
    return _r(V.likely_strings(_word_counts(spark, sf), 2e-4), "probability")


def likely_prefixes(spark, sf):
    return _r(V.likely_strings(_word_counts(spark, sf), 1e-2, prefixes=True), "probability")


def string_counts(spark, sf):
    """How often the sources' names stand in every document."""
    names = load(spark, sf, "mix_targets").select(F.col("source").alias("word"))
    return V.string_counts(load(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")), names.unionByName(spark.createDataFrame([("such as",), ("in",)], "word string")))


def trie_pattern(spark, sf):
    """The contents that one pattern of all part names matches, and those that are such a name: the same."""
    names = [r.p_name for r in load(spark, sf, "part").select("p_name").distinct().collect()]
    pattern = f"^(?:{V.any_of_pattern(names)})$"
    return load(spark, sf, "part").select("p_partkey", F.col("p_name").rlike(pattern).alias("whole"), F.concat("p_name", F.lit("x")).rlike(pattern).alias("longer"))


def relation_dictionary(spark, sf):
    """Pairs of contents whose second part the titles of pages begin with."""
    relations = load(spark, sf, "extractions").where(F.col("content").contains("::")).select(F.regexp_replace("content", r"\s+", " ").alias("relation"))
    relations = relations.select(F.concat_ws("::", F.trim(F.split("relation", "::", 2)[0]), F.trim(F.split("relation", "::", 2)[1])).alias("relation"))
    lines = load(spark, sf, "extractions").where(~F.col("content").contains("::")).select(F.regexp_replace("content", r"\s+", " ").alias("line"))
    return V.with_dictionary(relations, lines)


def relation_cross(spark, sf):
    a = load(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    b = load(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"))
    return V.relation_cross(a, b, "key")


def relation_verify(spark, sf):
    cut = F.split("entity", "::", 2)
    pairs = facts(spark, sf).where(F.col("entity").contains("::")).select(F.trim(cut[0]).alias("arg1"), F.trim(cut[1]).alias("arg2"))
    return V.not_functional(pairs)


def voted_perceptron(spark, sf):
    """A perceptron that tells embeddings of even labels from others, fitted on a bounded sample and applied to all."""
    rows = load(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 2 == 0).cast("int").alias("y"))
    model = V.VotedPerceptron(most_rows=2000)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(model.most_rows).collect()
    model.fit([(r.embedding, 1 if r.y else -1) for r in sample])
    return rows.select("vec_id", "y", model.predict(F.col("embedding")).alias("predicted"))


def seed_trials(spark, sf):
    """Trials of the experiment harness: repeatable seeds, and how many entities each finds."""
    out = None
    for trial in range(3):
        seeds = V.shuffled_trial(SEEDS, 12, trial)
        row = X.expand(pages(spark, sf), seeds, X.Expansion(TWO, "EWF")).agg(F.count(F.lit(1)).alias("n_entities"), F.count_if("is_seed").alias("n_seeds")).select(F.lit(trial).alias("trial"), "n_entities", "n_seeds")
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {f.__name__: f for f in (gold_synonyms, mark_correct, precision_recall, mean_avg_precision, best_f1, metrics_at_threshold, pr_at_k, merge_eval, experiment_grid, answer_intersect, answer_union, answer_topk, qa_hybrid, qa_seeds, qa_hints, load_questions, load_runs, load_answers, gold_discovery, match_answers, stat_metrics, threshold_sweep, cv_threshold, translation_accuracy, prefix_likelihood, likely_strings, likely_prefixes, string_counts, trie_pattern, relation_dictionary, relation_cross, relation_verify, voted_perceptron, seed_trials)}


def _synonyms(c: str) -> str:
    s = f"trim(replace(lower({c}), '-', ' '), ' ')"
    inner = f"regexp_full_match({s}, '(?s).+[.·・-].+')"
    latin, y = f"regexp_matches({s}, '[a-zA-Z]')", f"ends_with({s}, 'y')"
    parts = [s, f"CASE WHEN {inner} THEN trim(regexp_replace({s}, '[.·・-]', '', 'g'), ' ') END", f"CASE WHEN {inner} THEN trim(regexp_replace(regexp_replace({s}, '[.·・-]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') END", f"CASE WHEN {latin} AND {y} THEN substr({s}, 1, length({s}) - 1) || 'ies' END"]
    parts += [f"CASE WHEN {latin} AND NOT {y} THEN {x} END" for x in (f"{s} || 's'", f"{s} || 'es'", f"'the ' || {s}")]
    return f"unnest(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL AND x <> '')))"


_LISTS = f"""
best AS (SELECT list_id AS list, entity, max(wlw) AS weight FROM entity_scores WHERE list_id IS NOT NULL AND entity IS NOT NULL AND wlw IS NOT NULL AND NOT isnan(wlw) AND abs(wlw) < 1e300 GROUP BY ALL),
ranked AS (SELECT list, entity, weight / 20 AS score, row_number() OVER (PARTITION BY list ORDER BY weight DESC, length(entity), entity) AS rank FROM best),
ids AS (SELECT list_id AS list, entity, min(entity_id) AS gold_id FROM entity_scores WHERE list_id IS NOT NULL AND entity IS NOT NULL AND edf >= 20 GROUP BY ALL),
gold AS (SELECT list, gold_id, {_synonyms('entity')} AS synonym FROM ids),
n_gold AS (SELECT list, count(DISTINCT gold_id) AS n_gold FROM gold GROUP BY list),
known AS (SELECT list, synonym AS entity, min(gold_id) AS gold_id FROM gold GROUP BY ALL),
marked AS (SELECT list, entity, rank, score, CASE WHEN gold_id IS NULL THEN 0 WHEN row_number() OVER (PARTITION BY list, gold_id ORDER BY rank) = 1 THEN 1 ELSE 2 END AS correct FROM ranked LEFT JOIN known USING (list, entity)),
along AS (SELECT *, count(*) FILTER (correct > 0) OVER w / CAST(rank AS DOUBLE) AS precision, count(*) FILTER (correct = 1) OVER w AS firsts FROM marked WINDOW w AS (PARTITION BY list ORDER BY rank ROWS UNBOUNDED PRECEDING)),
measured AS (SELECT *, firsts / CAST(n_gold AS DOUBLE) AS recall, CASE WHEN precision + firsts / CAST(n_gold AS DOUBLE) > 0 THEN 2 * precision * (firsts / CAST(n_gold AS DOUBLE)) / (precision + firsts / CAST(n_gold AS DOUBLE)) ELSE 0 END AS f1 FROM along JOIN n_gold USING (list)),
maps AS (SELECT list, sum(CASE WHEN correct = 1 THEN precision ELSE 0 END) / max(n_gold) AS map FROM measured GROUP BY list)
"""
_M = f"WITH {_LISTS} "
_ANSWERS = """
own AS (SELECT CAST(query_idx AS VARCHAR) AS qid, lower(title) AS item, max(1.0 / rank) AS weight FROM warc WHERE query_idx IS NOT NULL AND title IS NOT NULL AND rank IS NOT NULL GROUP BY ALL),
raw AS (SELECT CAST(query_idx AS VARCHAR) AS qid, title, max(length(body)) / 500.0 AS weight FROM warc WHERE query_idx IS NOT NULL AND title IS NOT NULL AND body IS NOT NULL GROUP BY ALL),
other AS (SELECT qid, lower(title) AS item, weight FROM raw)
"""
_JUDGED = f"""{_ANSWERS},
judged AS (SELECT qid, item, weight / max(weight) OVER (PARTITION BY qid) AS weight, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, item) AS rank, regexp_matches(item, '^[aeiou]') AS correct FROM own),
n_right AS (SELECT qid, count(*) FILTER (correct) + 1 AS n_gold FROM judged GROUP BY qid)
"""

_W = f"WITH {FACTS}, w AS (SELECT entity AS word, sum(tf) AS n FROM facts GROUP BY entity HAVING sum(tf) IS NOT NULL), c AS (SELECT substr(word, 1, k) AS string, sum(n) / (SELECT sum(n) FROM w) AS p FROM w, unnest(range(0, length(word) + 1)) AS u(k) GROUP BY 1)"

SQL = {
    "qa_seeds": f"WITH {_ANSWERS} SELECT qid, item, round(weight, 9) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, item) AS k FROM own) WHERE k <= 2",
    "qa_hints": r"""WITH w AS (SELECT CAST(query_idx AS VARCHAR) AS qid, unnest(regexp_extract_all(lower(title), '[\p{L}]+')) AS keyword FROM warc WHERE query_idx IS NOT NULL), c AS (SELECT qid, keyword, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, keyword) AS k FROM c)
SELECT qid, string_agg(keyword, ' ' ORDER BY k DESC) AS hint FROM r WHERE k <= 3 GROUP BY qid""",
    "load_questions": r"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id % 4 <> 0), a AS (SELECT item_id, w, i, w[i + 1] AS v FROM w, unnest(range(0, len(w))) AS u(i))
SELECT item_id, CAST(item_id AS VARCHAR) AS qid, 'f' AS focus, 'A|B' AS types, CAST(count(DISTINCT v) AS INTEGER) AS n_keywords, CAST(count(*) AS INTEGER) AS n_answers, string_agg(v, '|' ORDER BY i % 3 DESC, v DESC) AS answers FROM a GROUP BY item_id""",
    "load_runs": r"""WITH l AS (SELECT CAST(query_idx AS VARCHAR) AS qid, trim(regexp_replace(title, '^[ \t\n\x0B\f\r]+', '')) AS a FROM warc WHERE query_idx IS NOT NULL AND rank IS NOT NULL AND rank <> 1 AND title IS NOT NULL)
SELECT qid, lower(regexp_replace(trim(regexp_replace(a, '[ _]+', ' ', 'g'), ' '), '``|' || chr(39) || chr(39) || '|,$', '', 'g')) AS answer FROM l WHERE a <> 'NIL' AND length(a) <> 1""",
    "load_answers": r"""WITH l AS (SELECT file_id, unnest(string_split(replace(payload, chr(13) || chr(10), chr(10)), chr(10))[2:]) AS line FROM wrapper_files WHERE payload IS NOT NULL), t AS (SELECT file_id, regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS line FROM l)
SELECT file_id, CAST(file_id AS VARCHAR) AS qid, trim(split_part(line, ',', 1), ' ') AS answer FROM t WHERE line <> '' AND NOT starts_with(line, 'Q:') AND NOT starts_with(line, '# ')""",
    "gold_discovery": r"""WITH l AS (SELECT doc_id, lang, unnest(string_split(regexp_replace(text, '[\r\n]+', ' ', 'g'), chr(9))) AS s FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) SELECT lang, count(DISTINCT doc_id) AS n_gold, count(*) AS n_synonyms FROM l WHERE trim(s, ' ') <> '' GROUP BY lang""",
    "likely_strings": _W + " SELECT string, round(p, 9) AS probability FROM c WHERE p >= 2e-4 AND string IN (SELECT word FROM w)",
    "likely_prefixes": _W + " SELECT string, round(p, 9) AS probability FROM c WHERE p >= 1e-2 AND string <> '' AND NOT EXISTS (SELECT 1 FROM c d WHERE d.p >= 1e-2 AND length(d.string) = length(c.string) + 1 AND starts_with(d.string, c.string))",
    "string_counts": """WITH n AS (SELECT source AS word FROM mix_targets UNION ALL SELECT 'such as' UNION ALL SELECT 'in'), p AS (SELECT doc_id, word, len(list_filter(range(1, length(text) + 1), lambda i: substr(lower(text), i, length(word)) = word)) AS n FROM documents, n WHERE contains(lower(text), word))
SELECT doc_id, word, n FROM p WHERE n > 0""",
    "trie_pattern": "SELECT p_partkey, true AS whole, p_name || 'x' IN (SELECT p_name FROM part) AS longer FROM part",
    "relation_dictionary": f"""WITH d AS (SELECT regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS line FROM extractions WHERE NOT contains(content, '::')), m AS (SELECT trim(regexp_extract(line, {q(T.language_pattern('en'))}), ' ') AS name, regexp_extract(line, '\\(([A-Z]+)\\)$', 1) AS short FROM d),
r AS (SELECT regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS c FROM extractions WHERE contains(content, '::')), p AS (SELECT trim(substr(c, 1, strpos(c, '::') - 1), ' ') AS a, trim(substr(c, strpos(c, '::') + 2), ' ') AS b FROM r)
SELECT DISTINCT trim(a || '::' || b, ' ') AS relation FROM p WHERE split_part(a || '::' || b, '::', 2) IN (SELECT name FROM m WHERE name <> '') UNION SELECT short || '::' || name FROM m WHERE short <> '' AND name <> ''""",
    "match_answers": f"""WITH RECURSIVE {_ANSWERS}, pats AS (SELECT DISTINCT CAST(query_idx AS VARCHAR) AS qid, regexp_extract(lower(title), '^([a-z]+)', 1) || '.*' AS pattern FROM warc WHERE query_idx IS NOT NULL AND regexp_extract(lower(title), '^([a-z]+)', 1) <> ''),
ranked AS (SELECT qid, item, CAST(row_number() OVER (PARTITION BY qid ORDER BY weight DESC, item) AS INTEGER) AS rank FROM own),
hits AS (SELECT qid, rank, list(pattern ORDER BY pattern) AS ps FROM ranked JOIN pats USING (qid) WHERE regexp_full_match(item, pattern, 'is') GROUP BY ALL),
nth AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM hits),
walk AS (SELECT qid, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS INTEGER) AS rank, false AS hit FROM (SELECT DISTINCT qid FROM nth)
  UNION ALL SELECT n.qid, n.k, CASE WHEN len(list_filter(n.ps, lambda p: NOT list_contains(w.used, p))) > 0 THEN list_append(w.used, list_filter(n.ps, lambda p: NOT list_contains(w.used, p))[1]) ELSE w.used END, n.rank, len(list_filter(n.ps, lambda p: NOT list_contains(w.used, p))) > 0 FROM walk w JOIN nth n ON n.qid = w.qid AND n.k = w.k + 1)
SELECT qid, item, rank, coalesce(hit, false) AS correct FROM ranked LEFT JOIN (SELECT qid, rank, hit FROM walk WHERE hit) USING (qid, rank)""",
    "experiment_grid": "WITH " + ", ".join(f"m_{f} AS (WITH {_LISTS.replace('wlw', f)} SELECT '{f}' AS feature, map FROM maps)" for f in ("log_score", "cell_value", "wlw", "gww", "edf")) + ", a AS (" + " UNION ALL ".join(f"SELECT * FROM m_{f}" for f in ("log_score", "cell_value", "wlw", "gww", "edf")) + ") SELECT coalesce(feature, 'mean') AS feature, round(avg(map), 9) AS map, count(*) AS n_lists FROM a GROUP BY ROLLUP (feature)",
    "gold_synonyms": f"SELECT content, {_synonyms('content')} AS synonym FROM (SELECT DISTINCT content FROM extractions WHERE content IS NOT NULL)",
    "mark_correct": _M + "SELECT list, entity, correct FROM marked",
    "precision_recall": _M + "SELECT list, CAST(rank AS INTEGER) AS rank, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM measured",
    "mean_avg_precision": _M + "SELECT list, round(map, 9) AS map FROM maps",
    "best_f1": _M + "SELECT list, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY f1 DESC, rank) AS k FROM measured) WHERE k = 1",
    "metrics_at_threshold": _M + "SELECT list, CAST(rank AS INTEGER) AS rank, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY rank DESC) AS k FROM measured WHERE score >= 0.25) WHERE k = 1",
    "pr_at_k": _M + """, c AS (SELECT list, sum(correct) AS hits, count(*) AS n FROM marked WHERE rank <= 10 AND correct < 2 GROUP BY list), pr AS (SELECT list, hits / CAST(n AS DOUBLE) AS p, hits / CAST(n_gold AS DOUBLE) AS r FROM c JOIN n_gold USING (list))
SELECT list, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM pr""",
    "merge_eval": _M + "SELECT ((list % 5) + 5) % 5 AS trial, round(avg(map), 9) AS map, count(map) AS n_trials FROM maps GROUP BY 1",
    "answer_intersect": f"WITH {_ANSWERS} SELECT qid, item, round(own.weight * other.weight, 9) AS weight FROM own JOIN other USING (qid, item)",
    "answer_union": f"WITH {_ANSWERS} SELECT qid, item, round(coalesce(own.weight, 1e-3) * coalesce(other.weight, 1e-3), 9) AS weight FROM own FULL JOIN other USING (qid, item)",
    "answer_topk": f"WITH {_ANSWERS} SELECT qid, item, round(w, 9) AS weight FROM (SELECT qid, title AS item, weight / max(weight) OVER (PARTITION BY qid) AS w FROM raw) WHERE w >= 0.5",
    "qa_hybrid": f"""WITH {_ANSWERS} SELECT 'OWN' AS method, qid, item, round(weight, 9) AS weight FROM own UNION ALL SELECT 'OTHER', qid, item, round(weight, 9) FROM other
UNION ALL SELECT 'INTERSECT', qid, item, round(own.weight * other.weight, 9) FROM own JOIN other USING (qid, item) UNION ALL SELECT 'UNION', qid, item, round(coalesce(own.weight, 1e-3) * coalesce(other.weight, 1e-3), 9) FROM own FULL JOIN other USING (qid, item)
UNION ALL SELECT 'METHOD1', qid, item, round(coalesce(own.weight, 1.0) * coalesce(other.weight, 1.0), 9) FROM own FULL JOIN other USING (qid, item)""",
    "stat_metrics": f"""WITH {_JUDGED}, run AS (SELECT *, count(*) FILTER (correct) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM judged JOIN n_right USING (qid)), f AS (SELECT *, 2.0 * hits / (rank + n_gold) AS f1, row_number() OVER (PARTITION BY qid ORDER BY 2.0 * hits / (rank + n_gold) DESC, rank) AS k FROM run)
SELECT qid, round(sum(CASE WHEN correct THEN hits / CAST(rank AS DOUBLE) ELSE 0 END) / max(n_gold), 9) AS avg_precision, round(max(f1), 9) AS best_f1, CAST(min(rank) FILTER (k = 1) AS INTEGER) AS best_rank FROM f GROUP BY qid""",
    "threshold_sweep": f"""WITH {_JUDGED}, steps AS (SELECT *, least(floor(weight * 10000), 10000) AS step FROM judged), grid AS (SELECT unnest(range(0, 10001)) AS s),
c AS (SELECT s, qid, count(*) AS n, count(*) FILTER (correct) AS hits FROM grid JOIN steps ON step >= s GROUP BY ALL), m AS (SELECT s, hits / CAST(n AS DOUBLE) AS p, hits / CAST(n_gold AS DOUBLE) AS r FROM c JOIN n_right USING (qid)),
t AS (SELECT s, sum(p) AS p, sum(r) AS r, sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f FROM m GROUP BY s)
SELECT round(s / 10000.0, 9) AS threshold, round(coalesce(p, 0) / (SELECT count(*) FROM n_right), 9) AS precision, round(coalesce(r, 0) / (SELECT count(*) FROM n_right), 9) AS recall, round(coalesce(f, 0) / (SELECT count(*) FROM n_right), 9) AS f1 FROM grid LEFT JOIN t USING (s)""",
    "translation_accuracy": """WITH p AS (SELECT DISTINCT trim(split_part(lower(content), '::', 1), ' ') AS a, trim(substr(lower(content), strpos(content, '::') + 2), ' ') AS b FROM extractions WHERE contains(content, '::'))
SELECT count(*) AS n, count(*) FILTER ((b, a) IN (SELECT (a, b) FROM p)) AS n_correct FROM p""",
    "prefix_likelihood": f"""WITH {FACTS}, w AS (SELECT entity AS word, sum(tf) AS n FROM facts GROUP BY entity HAVING sum(tf) IS NOT NULL), c AS (SELECT substr(word, 1, k) AS prefix, sum(n) AS n FROM w, unnest(range(0, length(word) + 1)) AS u(k) GROUP BY 1),
s AS (SELECT word, substr(word, 1, k) AS prefix, substr(word, 1, k - 1) AS parent FROM w, unnest(range(1, length(word) + 1)) AS u(k))
SELECT word, round(sum(ln(c.n / CAST(p.n AS DOUBLE))), 9) AS log_likelihood FROM s JOIN c USING (prefix) JOIN c p ON p.prefix = s.parent GROUP BY word""",
    "relation_cross": "SELECT n_nationkey AS key, n_name || '::' || c_name AS relation FROM nation JOIN customer ON n_nationkey = c_nationkey",
    "relation_verify": f"WITH {FACTS}, p AS (SELECT trim(split_part(entity, '::', 1), ' ') AS arg1, trim(substr(entity, strpos(entity, '::') + 2), ' ') AS arg2 FROM facts WHERE contains(entity, '::')) SELECT arg1, count(DISTINCT arg2) AS n FROM p GROUP BY arg1 HAVING count(DISTINCT arg2) > 1",
}
