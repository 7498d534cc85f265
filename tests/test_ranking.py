import math
import random

import pytest
from pyspark.sql import functions as F

from setweave.operators import entities as E
from setweave.operators import expansion as X
from setweave.operators import ranking as R
from setweave.plans import entity_queries as Q

FACTS = "doc bigint, wrapper string, entity string, tf bigint, ctx_len int, doc_len int"
NAV = [(1, w, e, 1, 25, 1319) for w, es in (("w1", ["nicht", "aulich", "für", "sch", "erüver"]), ("w2", ["aulich", "für", "sch", "erüver", "enau"])) for e in es]


def weights(df):
    return {r.entity: r.weight for r in df.collect()}


def test_worked_example(spark):
    facts = spark.createDataFrame(NAV, FACTS)
    assert weights(R.term_frequency(facts)) == {"aulich": 2, "für": 2, "sch": 2, "erüver": 2, "nicht": 1, "enau": 1}
    assert set(weights(R.document_frequency(facts)).values()) == {1} and weights(R.pattern_frequency(facts))["sch"] == 2
    assert weights(R.pattern_length(facts))["sch"] == pytest.approx(0.896046, abs=1e-6)
    bayes = weights(R.bayesian_sets(facts, ["aulich", "für"]))
    assert bayes["sch"] == pytest.approx(0.190620, abs=1e-6) and bayes["enau"] == pytest.approx(-0.597837, abs=1e-6)
    assert weights(R.bayesian_sets(facts, ["aulich", "für"], log=False))["sch"] == pytest.approx(math.exp(0.190620), abs=1e-6)
    edges = R.graph(facts)
    assert edges.count() == 36 and edges.select("src").distinct().count() == 9
    moves = R.transitions(edges).groupBy("src").agg(F.sum("p").alias("p")).collect()
    assert all(r.p == pytest.approx(1) for r in moves)


def test_walks_by_hand(spark):
    facts = spark.createDataFrame([(1, "w", "a", 1, 3, 9), (1, "w", "b", 1, 3, 9), (None, None, "lone", None, None, None)], FACTS)
    edges = R.graph(facts)
    p = {(r.src, r.dst): r.p for r in R.transitions(edges).collect()}
    state, nodes = {"c:a": 1.0}, sorted({s for s, _ in p})
    for _ in range(2):
        total = sum(state.values())
        new = {d: 0.99 * sum(p.get((s, d), 0) * v / total for s, v in state.items()) for d in nodes}
        new["c:a"] += 0.01
        state = new
    got = {r.id: r.value for r in R.random_walk(edges, ["c:a"], rounds=2, converged=None).collect()}
    assert all(got.get(n, 0) == pytest.approx(state[n]) for n in nodes)
    settled = weights(R.walk_weights(facts, ["a"]))
    assert settled["a"] > settled["b"] > 0 and "lone" not in settled
    assert set(weights(R.page_rank_weights(facts))) == {"a", "b"}


def test_walk_totals(spark):
    """Sums of all rounds follow from the seeds in the graph, also if some are outside."""
    facts = spark.createDataFrame([(d, f"w{d % 2}", e, 1, 3, 9) for d in range(4) for e in "abcd"[d % 3 :]], FACTS)
    edges = R.graph(facts)
    for seeds in (["c:a"], ["c:a", "c:b", "c:nowhere"], ["c:nowhere"]):
        moves = {(r.src, r.dst): r.p for r in R.transitions(edges).collect()}
        state = dict.fromkeys(seeds, 1.0)
        for _ in range(7):
            total, new = sum(state.values()), dict.fromkeys(seeds, 0.01 / len(seeds))
            for (s, d), p in moves.items():
                if s in state:
                    new[d] = new.get(d, 0) + 0.99 * p * state[s] / total
            state = new
        got = {r.id: r.value for r in R.random_walk(edges, seeds, rounds=7, converged=None).collect()}
        assert got.keys() == state.keys() and all(got[k] == pytest.approx(state[k]) for k in got)


def test_sparse_algebra(spark):
    m = spark.createDataFrame([("0", "0", 0.86), ("0", "1", 0.08), ("1", "0", -0.12), ("1", "1", 1.14)], "row string, col string, value double")
    v = spark.createDataFrame([("0", 200.0), ("1", 100.0)], "id string, value double")
    assert {r.id: round(r.value, 6) for r in R.matvec(m, v).collect()} == {"0": 180.0, "1": 90.0}
    assert {(r.row, r.col): round(r.value, 6) for r in R.matmul(m, m).collect()}[("0", "1")] == round(0.86 * 0.08 + 0.08 * 1.14, 6)
    assert R.distance(v, v.limit(0)).first().distance == pytest.approx(50000**0.5)
    assert R.normalized(v).agg(F.sum("value")).first()[0] == pytest.approx(1)


def test_empty_facts(spark):
    facts = spark.createDataFrame([], FACTS)
    for name in ("ETF", "EDF", "EWF", "WLW", "BSW"):
        assert R.rank(facts, ["a"], name).count() == 0


def test_entity_lists(spark):
    frame = lambda rows: spark.createDataFrame(rows, "entity string, weight double")
    a, b = frame([("x", 1.0), ("y", 2.0), (None, 5.0)]), frame([("y", 10.0), ("z", -1.0)])
    assert weights(E.union(a, b))["y"] == 10 and weights(E.merge(a, b))["y"] == 12 and set(weights(E.difference(a, b))) == {"x", None}
    assert weights(E.product(a, b)) == {"y": 20} and weights(E.interpolate(a, b, 0.5)) == {"y": 6} and E.overlap(a, b)
    scored = E.assign_score(frame([("s", 1.0), ("t", 3.0), ("u", 2.0)]), F.col("entity") == "s")
    order = [r.entity for r in E.top(scored, 3, by="score").collect()]
    assert order == ["s", "t", "u"]
    assert E.assign_score(a.limit(0)).count() == 0 and E.score_by_length(scored).count() == 3
    big = frame([(f"e{i:03}", float(i)) for i in range(30)])
    cut = weights(E.reduce_size(big, 20, 10))
    assert len(cut) == 10 and cut["e029"] == 10 and weights(E.reduce_size(big, 30, 10)) == weights(big)


def test_shrink_by_brute_force(spark):
    rows = [("new york city", 1.0), ("new york", 0.6), ("york city", 3.0), ("city", 0.5), ("old york", 0.2), ("york", 0.9), ("new", 5.0)]
    df = spark.createDataFrame(rows, "entity string, weight double")
    for power in (1.0, 4.0, float("inf")):
        order = sorted(rows, key=lambda r: (-len(r[0]), -r[1], r[0]))
        want = dict(order)
        for i, (n1, _) in enumerate(order):
            w1 = want[n1]
            for n2, _ in order[i + 1 :]:
                w2 = want[n2]
                if w2 and len(n1) > len(n2) and w1 * power > w2 and len(n2) / len(n1) >= E.MIN_LENGTH_RATIO and (n1.startswith(n2 + " ") or n1.endswith(" " + n2)) and w2 > w1:
                    want[n1], want[n2] = w2, 0.0
        assert weights(E.shrink(df, power)) == want


def test_relations(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("c", "a", 4), ("d", "z", 5)], "arg1 string, arg2 string, rank int")
    pick = lambda k: [(r.arg1, r.arg2) for r in E.unique_relations(df, k).orderBy("rank").collect()]
    assert pick(1) == [("a", "x"), ("b", "x"), ("c", "a"), ("d", "z")] and pick(2) == [("a", "x"), ("a", "y"), ("c", "a"), ("d", "z")] and pick(3) == [("a", "x"), ("d", "z")]


def test_seed_policies():
    ranked = [("p", 5.0), ("q", 4.0), ("r", 3.0), ("s", 2.0)]
    for policy in X.POLICIES:
        one, two = (X.SeedSelector(policy, ["a", "b", "c"], 2, 1, seed=4) for _ in range(2))
        mine = [one.select(ranked) for _ in range(5)]
        assert mine == [two.select(ranked) for _ in range(5)] and mine[0] and len({frozenset(m) for m in mine if m}) == len([m for m in mine if m])
    combos = X.ranked_combinations(ranked, 2)
    assert combos[0][0] == ("p", "q") and len(combos) == 6 and X.ranked_combinations(ranked, 5) == []
    assert X.subsets(["a", "b", "c", "d"], 2) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    with pytest.raises(ValueError):
        X.SeedSelector("OTHER", ["a"]).select()


def greedy(pairs):
    taken, keep = set(), []
    for a, b in pairs:
        fresh = a not in taken
        taken.add(a)
        if fresh:
            fresh = b not in taken
            taken.add(b)
        if fresh:
            keep.append((a, b))
    return keep


def test_unique_relations_against_brute_force(spark):
    rng = random.Random(7)
    for names in (5, 60, 400):
        pairs = [(f"n{rng.randrange(names)}", f"n{rng.randrange(names)}") for _ in range(300)]
        df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "arg1 string, arg2 string, rank int")
        assert [(r.arg1, r.arg2) for r in E.unique_relations(df, 3).orderBy("rank").collect()] == greedy(pairs)


def test_numbers_of_whole_lists(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aab"), f"e{i}", float(rng.randrange(3))) for i in range(500)]
    df = spark.createDataFrame(rows, "list string, entity string, weight double")
    want = lambda rs: [e for _, e, _ in sorted(rs, key=lambda r: (-r[2], len(r[1]), r[1]))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small pieces stay apart
    try:
        assert [(r["rank"], r.entity) for r in E.numbered(df).orderBy("rank").collect()] == list(enumerate(want(rows), 1))
        for k in "ab":
            assert [(r["rank"], r.entity) for r in E.numbered(df, ["list"]).where(F.col("list") == k).orderBy("rank").collect()] == list(enumerate(want([r for r in rows if r[0] == k]), 1))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_queries_take_all_entities_and_pairs(spark, tmp_path):
    pairs = [(f"{rng}x", f"{rng % 4999}y") for rng in range(6000)]
    rows = [(1, "w", f"{a}::{b}", 1) for a, b in pairs]
    spark.createDataFrame(rows, "doc_id bigint, wrapper_id string, content string, tf bigint").write.parquet(f"{tmp_path}/extractions.parquet")
    spark.createDataFrame([(1, "text")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.kind, r.n) for r in Q.relation_filter(spark, str(tmp_path)).groupBy("kind").agg(F.count("arg1").alias("n")).collect()} == {(1, 6000), (2, 4999)}
    order = sorted(pairs, key=lambda p: (len("::".join(p)), "::".join(p)))
    assert {(r.arg1, r.arg2) for r in Q.relation_filter_both(spark, str(tmp_path)).collect()} == set(greedy(order))
    assert [r.entity for r in Q.entity_order(spark, str(tmp_path)).orderBy("rank").collect()] == ["::".join(p) for p in order]
