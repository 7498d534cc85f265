"""Queries of induction and expansion, over all pages of the batch search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.operators import entities as E
from setweave.operators import expansion as X
from setweave.operators import patterns as P
from setweave.plans.text_queries import language_sql, load, plausible_sql, q, stopped_sql, tidy_sql

#: Entities that lists of the pages name.
SEEDS = (
    "セズ", "ブズヤホ", "モグテイ", "Kairuklartbitream", "Kolooglaindvuwai", "Preavotweaquuyai", "Stabocogleand", "Tealedimkleaskea", "Bostecakain", "Quiliquilaitu", "Praiwuskaimroopart", "Yayeawidreamert", "Cairocksto", "Crilimiteadai",
    "Lästuchkraukaudrul", "Schöschiengpauze", "Druskistimoodu", "Trinlipuvick", "Cremproskooquan", "Giteamotike", "Skorglubrer", "Druboobrahot", "Teamuhumhifea", "Meaprukolprearu", "Deanaickboprim", "Praiquadri", "Lunamo", "Naistustootril",
)
TWO = P.Settings(bracket=2)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "warc").select(F.col("record_id").alias("doc_id"), F.col("body").alias("text"))


def seed_occurrences(spark, sf):
    return P.seed_occurrences(pages(spark, sf), SEEDS).select("doc_id", F.lower("arg1").alias("seed"), "left", "right")


def wrapper_induction(spark, sf):
    return P.induce(pages(spark, sf), SEEDS, TWO, verify=False).select("doc_id", "left", "right", "n_seeds", "ctx_len")


def wrapper_extract(spark, sf):
    found = P.induce(pages(spark, sf), SEEDS, TWO, verify=False)
    return P.extractions(found).select("doc_id", "left", "right", F.col("arg1").alias("name"), "tf")


def wrapper_verify(spark, sf):
    return P.induce(pages(spark, sf), SEEDS, TWO).select("doc_id", "left", "right", "n_seeds")


def wrapper_extract_binary(spark, sf):
    """Pairs of tables that are made of the binary contents, 64 to a page; the most frequent pairs are the seeds."""
    cut = F.split("content", "::", 2)
    rows = load(spark, sf, "extractions").where(F.col("content").contains("::")).select((F.col("ext_id") / 64).cast("bigint").alias("doc_id"), "ext_id", F.trim(cut[0]).alias("a"), F.trim(cut[1]).alias("b"))
    best = rows.groupBy(F.lower("a").alias("a"), F.lower("b").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "a", "b").limit(60).collect()
    row = F.concat(F.lit("<tr><td>"), "a", F.lit("</td><td>"), "b", F.lit("</td></tr>"))
    tables = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ext_id", row.alias("row")))), lambda x: x["row"]), "").alias("text"))
    found = P.induce(tables, [(r.a, r.b) for r in best if r.a and r.b], TWO)
    return P.extractions(found).select("doc_id", "left", "middle", "right", "reversed", "arg1", "arg2", "tf")


def uniseed_wrappers(spark, sf):
    return P.induce(pages(spark, sf), SEEDS, P.Settings(uniseed=True)).select("doc_id", "left", "right", "ctx_len")


def bracketing_modes(spark, sf):
    """All seeds, the most, the heaviest (later seeds weigh less) and any two, over all pages."""
    weights = {i: 1 / (i + 1) for i in range(len(SEEDS))}
    modes = {0: P.Settings(bracket=0), -1: P.Settings(bracket=-1), -2: P.Settings(bracket=-2, weights=weights), 2: TWO}
    out = [P.induce(pages(spark, sf), SEEDS, how).groupBy("n_seeds").agg(F.count(F.lit(1)).alias("n_patterns")).select(F.lit(b).alias("bracket"), "n_seeds", "n_patterns") for b, how in modes.items()]
    return reduce(DataFrame.unionByName, out)


def context_prefixes(spark, sf):
    """Prefixes of the right contexts of all occurrences that two seeds of a page share."""
    occ = P.seed_occurrences(pages(spark, sf), SEEDS)
    each = F.explode(F.transform(F.sequence(F.lit(1), F.length("right")), lambda k: F.substring("right", F.lit(1), k))).alias("prefix")
    return occ.select("doc_id", F.lower("arg1").alias("seed"), each).groupBy("doc_id", "prefix").agg(F.count_distinct("seed").alias("n_seeds")).where("n_seeds > 1")


def list_quality(spark, sf):
    return P.pattern_quality(P.induce(pages(spark, sf), SEEDS, TWO)).select("n_patterns", F.round("quality", 6).alias("quality"))


def original_forms(spark, sf):
    return P.written_forms(P.induce(pages(spark, sf), SEEDS, TWO)).select("name", "written", F.round("weight", 6).alias("weight"), "rank")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("entity", F.round("weight", 6).alias("weight"), F.round("score", 8).alias("score"), "is_seed")


def expand_set(spark, sf):
    return _rounded(X.expand(pages(spark, sf), SEEDS, X.Expansion(TWO)))


def expand_two_seed_sets(spark, sf):
    return _rounded(X.expand(pages(spark, sf), SEEDS, X.Expansion(TWO, "EDF", noisy=True), page_seeds=SEEDS[:8]))


def expand_iterative(spark, sf):
    chosen = X.SeedSelector("FSS_SEMI_SUPERVISED", SEEDS, n_true=10, n_possible=1)
    return _rounded(X.iterate(pages(spark, sf), chosen, 2, X.Expansion(TWO, "ETF")))


def expand_iterative_reuse(spark, sf):
    """The same with the pages of the first round only."""
    chosen = X.SeedSelector("FSS_SEMI_SUPERVISED", SEEDS, n_true=10, n_possible=1)
    return _rounded(X.iterate(pages(spark, sf), chosen, 2, X.Expansion(TWO, "ETF"), reuse=True))


def _policy(name: str):
    def query(spark, sf):
        best = E.top(X.expand(pages(spark, sf), SEEDS, X.Expansion(TWO, "ETF", noisy=True)), 40, by="score")
        ranked = [(r.entity, r.weight) for r in best.collect()]
        chooser = X.SeedSelector(name, SEEDS[:6], n_true=2, n_possible=1)
        rounds = [(i, chooser.select(ranked)) for i in range(6)]
        return spark.createDataFrame([(i, "|".join(s)) for i, s in rounds if s], "round int, seeds string")

    return query


def ranked_combos(spark, sf):
    best = E.top(X.expand(pages(spark, sf), SEEDS, X.Expansion(TWO, "WLW", noisy=True)), 16, by="weight")
    rows = X.ranked_combinations([(r.entity, r.weight) for r in best.collect()], 2)
    return spark.createDataFrame([(i, "|".join(c), round(w, 6)) for i, (c, w) in enumerate(rows)], "pos int, combination string, weight double")


def paired_combos(spark, sf):
    best = E.top(X.expand(pages(spark, sf), SEEDS, X.Expansion(TWO, "WLW", noisy=True)), 10, by="weight")
    rows = X.paired_combinations(SEEDS[:5], 2, [(r.entity, r.weight) for r in best.collect()], 1, seed=3)
    return spark.createDataFrame([(i, "|".join(c)) for i, c in enumerate(rows)], "pos int, combination string")


def combinations(spark, sf):
    """All triples of sources that have target shares, in order."""
    items = load(spark, sf, "mix_targets").select(F.col("source").alias("item"), F.col("source").alias("pos"))
    return X.combination_table(items, 3)


QUERIES = {f.__name__: f for f in (seed_occurrences, wrapper_induction, wrapper_extract, wrapper_verify, wrapper_extract_binary, uniseed_wrappers, bracketing_modes, context_prefixes, list_quality, original_forms, expand_set, expand_two_seed_sets, expand_iterative, expand_iterative_reuse, ranked_combos, paired_combos, combinations)} | {f"seed_policy_{p.lower()}": _policy(p) for p in X.POLICIES}

_SEED_ROWS = ", ".join(f"({q(s.lower())})" for s in SEEDS)
OCCURRENCES = f"""
seeds(seed) AS (VALUES {_SEED_ROWS}),
bodies AS (SELECT record_id AS doc_id, body, lower(body) AS low FROM warc WHERE body IS NOT NULL),
hits AS (SELECT doc_id, body, seed, unnest(list_filter(range(1, length(low) + 1), lambda i: substr(low, i, length(seed)) = seed)) AS i FROM bodies, seeds WHERE contains(low, seed)),
occ AS (SELECT doc_id, seed, i, substr(body, greatest(1, i - 100), i - greatest(1, i - 100)) AS l, substr(body, i + length(seed), 100) AS r FROM hits WHERE i > 1 AND i + length(seed) <= length(body))
"""
_ONE_WAY = """
{x}p AS (SELECT doc_id, seed, i, l, r, substr({a}, 1, k) AS p, CASE WHEN {b}[1] = ' ' THEN substr({b}, 1, 2) ELSE substr({b}, 1, 1) END AS t FROM rev, unnest(range(1, length({a}) + 1)) AS u(k) WHERE substr({a}, 1, k) <> ' '),
{x}ok AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, p, t FROM {x}p GROUP BY ALL HAVING count(DISTINCT seed) >= 2)),
{x}max AS (SELECT doc_id, p FROM {x}ok o WHERE NOT EXISTS (SELECT 1 FROM {x}ok n WHERE n.doc_id = o.doc_id AND length(n.p) = length(o.p) + 1 AND starts_with(n.p, o.p))),
{x}q AS (SELECT m.doc_id, m.p, substr(o.{b}, 1, k) AS s FROM {x}max m JOIN rev o ON o.doc_id = m.doc_id AND starts_with(o.{a}, m.p), unnest(range(1, length(o.{b}) + 1)) AS u(k) WHERE substr(o.{b}, 1, k) <> ' ' GROUP BY ALL HAVING count(DISTINCT o.seed) >= 2),
{x}pair AS (SELECT doc_id, p, s FROM {x}q o WHERE NOT EXISTS (SELECT 1 FROM {x}q n WHERE n.doc_id = o.doc_id AND n.p = o.p AND length(n.s) = length(o.s) + 1 AND starts_with(n.s, o.s)))
"""
PATTERNS = f"""{OCCURRENCES},
both_seeds AS (SELECT doc_id FROM occ GROUP BY doc_id HAVING count(DISTINCT seed) >= 2),
rev AS (SELECT doc_id, seed, i, reverse(l) AS l, r FROM occ WHERE doc_id IN (SELECT doc_id FROM both_seeds)),
{_ONE_WAY.format(x="a", a="l", b="r")}, {_ONE_WAY.format(x="b", a="r", b="l")},
pairs AS (SELECT doc_id, p AS l, s AS r FROM apair UNION SELECT doc_id, s, p FROM bpair),
patterns AS (SELECT doc_id, reverse(p.l) AS lft, p.r AS rgt, count(DISTINCT seed) AS n_seeds FROM pairs p JOIN rev o USING (doc_id) WHERE starts_with(o.l, p.l) AND starts_with(o.r, p.r) AND p.l <> ' ' AND p.r <> ' ' GROUP BY ALL)
"""
CONTENTS = f"""{PATTERNS},
ends AS (SELECT p.doc_id, lft, rgt, n_seeds, body, unnest(list_filter(range(length(lft) + 1, length(body) + 2), lambda i: substr(body, i - length(lft), length(lft)) = lft)) AS e FROM patterns p JOIN bodies USING (doc_id)),
stops AS (SELECT *, strpos(substr(body, e + 2), rgt) AS k, lead(e) OVER (PARTITION BY doc_id, lft, rgt ORDER BY e) AS next_e FROM ends),
raw AS (SELECT doc_id, lft, rgt, n_seeds, length(body) AS doc_len, substr(body, e, k + 1) AS c FROM stops WHERE k > 0 AND (next_e IS NULL OR next_e > e + k + 1)),
named AS (SELECT *, {tidy_sql(tidy_sql('c', True))} AS name FROM raw),
good AS (SELECT * FROM named WHERE {plausible_sql('name')} AND NOT {stopped_sql('name')} AND {language_sql('name', 'un')})
"""
VERIFIED = f"""{CONTENTS},
names AS (SELECT DISTINCT {tidy_sql('seed')} AS name FROM seeds),
fine AS (SELECT doc_id, lft, rgt, n_seeds FROM good GROUP BY ALL HAVING count(DISTINCT name) FILTER (name IN (SELECT name FROM names)) >= n_seeds AND count(*) FILTER (name NOT IN (SELECT name FROM names)) > 0)
"""
_FACTS = VERIFIED + ", facts AS (SELECT doc_id, lft, rgt, name, doc_len, length(lft) + length(rgt) AS ctx_len, count(*) AS tf FROM good SEMI JOIN fine USING (doc_id, lft, rgt) GROUP BY ALL)"
_SCORE = """, m AS (SELECT min(weight) - 1e-8 AS lo, max(weight) AS hi FROM w),
s AS (SELECT entity, weight, entity IN (SELECT name FROM names) AS is_seed, ({w} - lo) / (hi + abs(hi) * 1e-8 - lo) AS score FROM w, m), t AS (SELECT avg(length(entity)) AS a, stddev_pop(length(entity)) AS d FROM s),
p AS (SELECT *, exp(-0.5 * pow((length(entity) - a) / d, 2)) / (d * sqrt(2 * pi())) AS p FROM s, t),
scored AS (SELECT entity, weight, CASE WHEN d = 0 THEN score WHEN p < 1e-4 THEN 0 ELSE score + p * 1e-8 END AS score, is_seed FROM p)"""
_SHOWN = " SELECT entity, round(weight, 6) AS weight, round(score, 8) AS score, is_seed FROM scored"
_CLEAN = "CASE WHEN entity IN (SELECT name FROM names) THEN hi + weight * 1e-8 ELSE weight END"
_WLW = ", w AS (SELECT name AS entity, sum(x) AS weight FROM (SELECT name, doc_id, lft, rgt, max(ln(ctx_len) / ln(doc_len)) AS x FROM facts GROUP BY ALL) GROUP BY name)"
#: Scored entities of an expansion with noisy seeds.
_SCORED = _FACTS + _WLW + _SCORE.format(w="weight")
_FIRST_SEEDS = _FACTS.replace("bodies AS (SELECT record_id AS doc_id, body, lower(body) AS low FROM warc WHERE body IS NOT NULL)", "bodies AS (SELECT record_id AS doc_id, body, lower(body) AS low FROM warc WHERE " + " OR ".join(f"contains(lower(body), {q(s.lower())})" for s in SEEDS[:8]) + ")")

SQL = {
    "seed_occurrences": f'WITH {OCCURRENCES} SELECT doc_id, seed, l AS "left", r AS "right" FROM occ',
    "wrapper_induction": f'WITH {PATTERNS} SELECT doc_id, lft AS "left", rgt AS "right", CAST(n_seeds AS INTEGER) AS n_seeds, CAST(length(lft) + length(rgt) AS INTEGER) AS ctx_len FROM patterns',
    "wrapper_extract": f'WITH {CONTENTS} SELECT doc_id, lft AS "left", rgt AS "right", name, count(*) AS tf FROM good GROUP BY ALL',
    "wrapper_verify": f'WITH {VERIFIED} SELECT doc_id, lft AS "left", rgt AS "right", CAST(n_seeds AS INTEGER) AS n_seeds FROM fine',
    "context_prefixes": f"WITH {OCCURRENCES} SELECT doc_id, substr(r, 1, k) AS prefix, count(DISTINCT seed) AS n_seeds FROM occ, unnest(range(1, length(r) + 1)) AS u(k) GROUP BY ALL HAVING count(DISTINCT seed) > 1",
    "list_quality": f"WITH {VERIFIED} SELECT count(*) AS n_patterns, round(sum(n_seeds * ln(length(lft) + length(rgt))) / count(*), 6) AS quality FROM fine",
    "original_forms": f"""WITH {VERIFIED}, v AS (SELECT DISTINCT doc_id, lft, rgt, name, {tidy_sql('c', True)} AS written FROM good SEMI JOIN fine USING (doc_id, lft, rgt)),
w AS (SELECT name, written, sum(CASE WHEN name = written THEN 0.1 WHEN contains(written, '-') THEN 0.5 ELSE 1.0 END) AS weight FROM v GROUP BY ALL)
SELECT name, written, round(CAST(weight AS DOUBLE), 6) AS weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY weight DESC, written) AS rank FROM w) WHERE rank <= 10""",
    "expand_set": f"WITH {_FACTS}{_WLW}{_SCORE.format(w=_CLEAN)}{_SHOWN}",
    "expand_two_seed_sets": f"WITH {_FIRST_SEEDS}, w AS (SELECT name AS entity, CAST(count(DISTINCT doc_id) AS DOUBLE) AS weight FROM facts GROUP BY name){_SCORE.format(w='weight')}{_SHOWN}",
    "ranked_combos": f"""WITH {_SCORED}, r AS (SELECT entity, weight, row_number() OVER (ORDER BY weight DESC, length(entity), entity) AS k FROM scored), f AS (SELECT * FROM r WHERE k <= 16),
c AS (SELECT a.entity || '|' || b.entity AS combination, ln(a.weight) + ln(b.weight) AS v, a.entity AS x, b.entity AS y FROM f a JOIN f b ON a.k < b.k) SELECT CAST(row_number() OVER (ORDER BY v DESC, x, y) - 1 AS INTEGER) AS pos, combination, round(v, 6) AS weight FROM c""",
    "seed_policy_cis_supervised": f"WITH s(k, seed) AS (VALUES {', '.join(f'({i}, {q(x)})' for i, x in enumerate(SEEDS[:6]))}) SELECT CAST(a.k AS INTEGER) AS round, a.seed || '|' || b.seed AS seeds FROM s a JOIN s b ON b.k = a.k + 1",
    "combinations": "SELECT a.source AS item_1, b.source AS item_2, c.source AS item_3 FROM mix_targets a JOIN mix_targets b ON a.source < b.source JOIN mix_targets c ON b.source < c.source",
}
