import random

import pytest
from pyspark.sql import functions as F

from setweave.operators import category as K
from setweave.operators import evaluation as V
from setweave.operators import proximity as N
from setweave.plans import evaluation_queries as L
from setweave.plans import proximity_queries as Q


def test_synonyms(spark):
    cases = {"city": {"city", "cities"}, "dog": {"dog", "dogs", "doges", "the dog"}, "St.Kitts": {"st.kitts", "stkitts", "st kitts", "st.kittss", "st.kittses", "the st.kitts"}, "東京": {"東京"}, "": set()}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: set(r.s) for r in df.select("n", V.synonyms(F.col("n")).alias("s")).collect()} == cases


def test_marks_and_measures(spark):
    ranked = spark.createDataFrame([("l", e, i + 1, 1.0 - i / 10) for i, e in enumerate(["a", "x", "a2", "b"])] + [("m", "x", 1, 0.9)], "list string, entity string, rank int, score double")
    gold = spark.createDataFrame([("l", 1, "a"), ("l", 1, "a2"), ("l", 2, "b"), ("m", 1, "z")], "list string, gold_id int, synonym string")
    n = gold.groupBy("list").agg(F.count_distinct("gold_id").alias("n_gold"))
    marked = V.mark(ranked, gold)
    assert {r.entity: r.correct for r in marked.where("list = 'l'").collect()} == {"a": 1, "x": 0, "a2": 2, "b": 1}
    measured = V.precision_recall(marked, n)
    assert {r.list: round(r.map, 6) for r in V.mean_average_precision(measured).collect()} == {"l": round((1 + 0.75) / 2, 6), "m": 0.0}
    best = {r.list: (round(r.f1, 6), r["rank"]) for r in V.best_f1(measured).collect()}
    assert best["l"] == (round(2 * 0.75 / 1.75, 6), 4) and best["m"] == (0.0, 1)
    assert V.at_threshold(measured, 0.85).where("list = 'l'").first()["rank"] == 2
    top = V.at_rank(marked, n, 4).where("list = 'l'").first()
    assert (top.precision, top.recall) == (pytest.approx(2 / 3), 1.0)


def test_answers(spark):
    frame = lambda rows: spark.createDataFrame(rows, "qid string, item string, weight double")
    a, b = frame([("q", "A", 0.5), ("q", "b", 1.0)]), frame([("q", "a", 0.5), ("q", "c", 0.2)])
    get = lambda d: {r.item: round(r.weight, 6) for r in d.collect()}
    assert get(V.answer_intersect(a, b)) == {"a": 0.25} and get(V.answer_union(a, b, 0.1)) == {"a": 0.25, "b": 0.1, "c": 0.02}
    assert get(V.answer_top(a, 0.6)) == {"b": 1.0}
    patterns = spark.createDataFrame([("q", "a.*"), ("q", "x")], "qid string, pattern string")
    got = {r.item: r.correct for r in V.match_answers(frame([("q", "ab", 3.0), ("q", "AC", 2.0), ("q", "x", 1.0), ("r", "x", 1.0)]), patterns).collect()}
    assert got["ab"] and not got["AC"]
    with pytest.raises(ValueError):
        V.hybrid("NONE", a, b)


def test_sweep_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"q{i % 4}", f"i{i}", rng.random(), rng.random() < 0.4) for i in range(60)]
    judged = spark.createDataFrame(rows, "qid string, item string, weight double, correct boolean")
    n = spark.createDataFrame([(f"q{i}", 8) for i in range(5)], "qid string, n_gold int")
    for r in V.threshold_sweep(judged, n, 20).collect():
        f = []
        for qid in {q for q, *_ in rows}:
            chosen = [c for q, _, w, c in rows if q == qid and int(w * 20) >= round(r.threshold * 20)]
            hits = sum(chosen)
            f.append(2 * hits / (len(chosen) + 8) if chosen else 0)
        assert r.f1 == pytest.approx(sum(f) / 5)


def test_similar_pairs_misses_none(spark):
    rng = random.Random(6)
    make = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 12)))
    a, b = [make() for _ in range(60)] + ["", None], [make() for _ in range(60)] + ["x" * 300]
    da, db = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (a, b))

    def edits(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (c != d)))
            row = new
        return row[-1]

    for least in (0.8, 0.6):
        want = {(x, y) for x in set(a) - {"", None} for y in set(b) if 1 - edits(x, y) / max(len(x), len(y)) >= least - 1e-12}
        assert {(r.name_a, r.name_b) for r in N.similar_pairs(da, db, least).collect()} == want


def test_similar_pairs_gathers_no_keys_in_the_driver(spark, tmp_path):
    rng = random.Random(7)
    bases = ["".join(rng.choice("abcé") for _ in range(n)) for n in range(4, 25) for _ in range(2)]

    def changed(s):
        for _ in range(rng.randrange(5)):
            i, c = rng.randrange(len(s)), rng.choice(["", "a", "bé"])
            s = s[:i] + c + s[i + rng.randrange(2) :]
        return s or "a"

    for side in "ab":
        spark.createDataFrame([(changed(x),) for x in bases for _ in range(6)], "name string").distinct().write.parquet(f"{tmp_path}/{side}")
    da, db = (spark.read.parquet(f"{tmp_path}/{side}") for side in "ab")
    pairs = N.similar_pairs(da, db)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin" not in plan
    every = da.select(F.col("name").alias("x")).crossJoin(db.select(F.col("name").alias("y")))
    near = every.where(F.levenshtein("x", "y") <= 0.2 * F.greatest(F.length("x"), F.length("y")) + 1e-9)
    want = {(r.x, r.y) for r in near.collect()}
    assert len(want) > 300 and {(r.name_a, r.name_b) for r in pairs.collect()} == want


def test_cross_verify_gathers_no_keys_in_the_driver(spark, tmp_path):
    scores = [("fort alpha", 3), ("fort alpha", 5), ("port beta", 2), ("gamma", None), ("", 9), (None, 9)]
    names = [("Fort  Alpha", 1), ("fort_alpho", 1), ("fort alpho!", 3), ("Port Bet", 2), ("port betu", 2), ("gamma", 1), ("x" * 49, 1), ("", 1), (None, 1), ("port beta", None)]
    spark.createDataFrame(scores, "entity string, edf bigint").write.parquet(f"{tmp_path}/entity_scores.parquet")
    spark.createDataFrame(names, "content string, tf int").write.parquet(f"{tmp_path}/extractions.parquet")
    best = Q.cross_verify(spark, str(tmp_path))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan and plan.count("struct<content:string") == 1
    assert {r.source: (r.entity, r.weight) for r in best.collect()} == {"fort alpha": ("fort alpho", 18.0), "port beta": ("port betu", 3.555556)}


def test_annotations_and_chunks(spark):
    texts = spark.createDataFrame([(1, 0, "Foo such as Bar near Baz, Bar"), (2, 0, "nothing"), (3, 0, None)], "doc_id int, excerpt int, text string")
    got = N.annotate(texts, ["such as"], ["bar", "+near baz"])
    assert sorted((r.kind, r.start, r.end) for r in got.collect()) == [("source", 4, 11), ("target", 12, 15), ("target", 16, 24), ("target", 26, 29)]
    score = N.proximity_score(got).first().score
    assert score == pytest.approx(1 / 3 + 1 / 7 + 1 / 17)
    assert spark.range(1).select(N.chop(F.lit("x such-as y"), "such as")).first()[0] == " y"
    assert spark.range(1).select(N.split_list(F.lit("a or the b and c, etc. dogs.Next"))).first()[0] == ["a", "the b", "c,", "dogs", "Next"]
    found = K.instances(texts.select("doc_id", "text"), K.list_queries("foo"))
    assert {r.entity for r in found.collect()} == {"bar near baz", "bar"}
    assert K.instances(texts.limit(0), K.list_queries("foo")).count() == 0
    queries = spark.createDataFrame([('"a b" c  "d" e',), ("x",), ('"y"',), (None,)], "q string").withColumn("b", K.back_off(F.col("q")))
    assert {r.q: r.b for r in queries.collect()} == {'"a b" c  "d" e': '"a b" "d" c e', "x": "x", '"y"': '"y"', None: ""}


def test_perceptron():
    data = [((1.0, x), 1) for x in (1, 2, 3)] + [((1.0, -x), -1) for x in (1, 2, 3)]
    model = V.VotedPerceptron().fit(data)
    assert all(model.decide(x)[0] == y for x, y in data)


def test_keywords_late_in_a_text_count(spark, tmp_path):
    row = (1, "http://x.test/list/fort.html", "x " * 1000 + "fort", "x.test", 0.5)
    spark.createDataFrame([row], "doc_id bigint, url string, text string, site string, weight double").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.keyword: r.score for r in Q.predict_category(spark, str(tmp_path)).collect()} == {"fort": 2.5, "list": 1.5}


def test_long_lists_are_measured_whole(spark, tmp_path):
    rows = [(1, i, f"e{i:04}", 3000.0 - i, 20 if i == 1500 else 0) for i in range(1501)]
    spark.createDataFrame(rows, "list_id bigint, entity_id bigint, entity string, wlw double, edf bigint").write.parquet(f"{tmp_path}/entity_scores.parquet")
    last = L.precision_recall(spark, str(tmp_path)).orderBy("rank").collect()[-1]
    assert (last["rank"], last.recall, last.precision) == (1501, 1.0, round(1 / 1501, 9))
    measured = L.measured(spark, str(tmp_path)).orderBy("rank").collect()
    pieces = V.precision_recall(L.marked(spark, str(tmp_path)), L.n_gold(spark, str(tmp_path)), piece=7).orderBy("rank").collect()
    assert [(r["rank"], r.precision, r.recall, r.f1) for r in pieces] == [(r["rank"], r.precision, r.recall, r.f1) for r in measured]


def greedy_answers(rows, patterns):
    import re

    out = {}
    for q in {r[0] for r in rows}:
        left = sorted(set(patterns.get(q, ())))
        for rank, (_, item, _) in enumerate(sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])), 1):
            hit = next((p for p in left if re.fullmatch(p, item, re.I | re.S)), None)
            if hit:
                left.remove(hit)
            out[q, item] = (rank, hit is not None)
    return out


def test_answers_against_brute_force(spark):
    rng = random.Random(3)
    rows = list({(q, i): (f"q{q}", f"{rng.choice('abc')}{rng.choice('abc')}{i}", float(rng.randrange(4))) for q in range(4) for i in range(40)}.values())
    patterns = {f"q{q}": [rng.choice(["a.*", "B.*", ".b.*", "[ab]{2}.*", "c", "cc.*"]) for _ in range(q * 2)] for q in range(4)}
    frame = spark.createDataFrame(rows, "qid string, item string, weight double")
    given = spark.createDataFrame([(q, p) for q, ps in patterns.items() for p in ps], "qid string, pattern string")
    assert {(r.qid, r.item): (r["rank"], r.correct) for r in V.match_answers(frame, given).collect()} == greedy_answers(rows, patterns)


def test_readers_of_questions(spark, tmp_path):
    lines = ["# 12", "Q: what?", "", "one, first", "two", "# 13", "three"]
    frame = spark.createDataFrame(list(enumerate(lines)), "pos int, line string")
    assert sorted((r.qid, r.answer) for r in V.true_answers(frame).collect()) == [("12", "one"), ("12", "two"), ("13", "three")]
    run = spark.createDataFrame([("7 x 1 New_York ,",), ("7 Q0 1 no",), ("7 x 2 NIL",), ("7 x 3 z",), ("bad line",), ("8 r 1 ``Ab''",)], "line string")
    assert sorted((r.qid, r.answer) for r in V.run_answers(run).collect()) == [("7", "new york "), ("8", "ab")]
    xml = '<AnswerGenerator><RequestObject><Question type="list" trecID="9">Who?</Question><AnswerTypeInfo><AnswerType>NE-&gt;P</AnswerType><Focus>f</Focus></AnswerTypeInfo><Keywords><Keyword><Term relFrequency="0.1">a</Term></Keyword><Keyword><Term relFrequency="0.9">b</Term></Keyword><Keyword><Term relFrequency="0.1">a</Term></Keyword></Keywords></RequestObject><RequestFillSet><RequestFill><Answer confidence="0.2">x</Answer></RequestFill><RequestFill><Answer confidence="0.7">y</Answer></RequestFill></RequestFillSet></AnswerGenerator>'
    files = spark.createDataFrame([(1, xml), (2, xml.replace("list", "factoid")), (3, None)], "id int, xml string")
    (r,) = V.question_files(files).collect()
    assert (r.id, r.qid, r.question, r.focus, r.types) == (1, "9", "Who?", "f", ["NE", "P"])
    assert [x.value for x in r.keywords] == ["b", "a"] and [(x.value, x.weight) for x in r.answers] == [("y", 0.7), ("x", 0.2)]
    for name, text in {"en/us-states.txt": "Iowa\tIA\nOhio\n", "ja/k.txt": "x", "en/skip.csv": "z"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(g.lang, g.name, g.gold_id, g.pos, g.synonym) for g in V.gold_files(spark, str(tmp_path)).collect()}
    assert got == {("en", "us-states", 0, 0, "Iowa"), ("en", "us-states", 0, 1, "IA"), ("en", "us-states", 1, 0, "Ohio"), ("ja", "k", 0, 0, "x")}
    assert {g.name for g in V.gold_files(spark, str(tmp_path), "ja").collect()} == {"k"}


def test_seeds_and_hints_of_questions(spark):
    answers = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 3.0), ("q", "c", 2.0), ("r", "d", 0.0)], "qid string, item string, weight double")
    assert sorted((r.qid, r.item) for r in V.top_answers(answers, 2).collect()) == [("q", "b"), ("q", "c"), ("r", "d")]
    keys = answers.withColumnRenamed("item", "keyword")
    assert {r.qid: r.hint for r in V.hints(keys, 2).collect()} == {"q": "c b", "r": "d"}
    assert {r.item: r.weight for r in V.hybrid("METHOD1", answers, answers.where("item = 'a'").withColumn("weight", F.lit(5.0))).collect()} == {"a": 5.0, "b": 3.0, "c": 2.0, "d": 0.0}


def test_counted_strings(spark, monkeypatch):
    import re

    words = spark.createDataFrame([("ab", 3), ("abc", 1), ("b", 4), ("abd", 2)], "word string, n bigint")
    assert {r.string: r.probability for r in V.likely_strings(words, 0.2).collect()} == {"ab": 0.6, "b": 0.4, "abd": 0.2}
    assert {r.string for r in V.likely_strings(words, 0.5, prefixes=True).collect()} == {"ab"}
    assert V.likely_strings(words.limit(0), 0.5).count() == 0
    docs = spark.createDataFrame([(1, "ababab"), (2, "aaa.b"), (3, None), (4, "")], "doc_id int, text string")
    given = spark.createDataFrame([("ab",), ("aba",), ("aa",), (".",), ("",), (None,)], "word string")
    want = {(1, "ab"): 3, (1, "aba"): 2, (2, "aa"): 2, (2, "."): 1}
    for few in (1000, 2):
        monkeypatch.setattr(V, "FEW_WORDS", few)
        assert {(r.doc_id, r.word): r.n for r in V.string_counts(docs, given).collect()} == want
    names = ["ab", "abc", "b.d", "", "x"]
    pattern = V.any_of_pattern(names)
    assert all(re.fullmatch(pattern, n) for n in names) and not any(re.fullmatch(pattern, n) for n in ("a", "bxd", "abcd", "xx")) and V.any_of_pattern([]) == ""


def test_dictionary(spark):
    relations = spark.createDataFrame([("x::Federal Bureau",), ("y::None",), ("bad",)], "relation string")
    lines = spark.createDataFrame([("Federal Bureau (FB)",), ("12",), ("Other thing",)], "line string")
    assert {r.relation for r in V.with_dictionary(relations, lines).collect()} == {"x::Federal Bureau", "FB::Federal Bureau"}


def test_cut_annotations(spark):
    assert N.around(0, 10, [(2, 4), (6, 8)]) == [(0, 2), (4, 6), (8, 10)] and N.around(0, 5, []) == [(0, 5)] and N.around(1, 3, [(0, 9)]) == [] and N.around(2, 9, [(0, 4)]) == [(4, 9)]
    df = spark.createDataFrame([(1, 0, "old Disney movies e.g. now")], "doc_id int, excerpt int, text string")
    got = {(r.kind, r.start, r.end) for r in N.annotate(df, ["movies"], ["Disney movies e.g"]).collect()}
    assert got == {("source", 11, 17), ("target", 4, 10), ("target", 18, 21)}


def test_collapse_against_brute_force(spark):
    rng = random.Random(11)
    rows = list({(n := "".join(rng.choice("ab") for _ in range(rng.randrange(0, 6)))): (n, float(rng.randrange(5))) for _ in range(80)}.values())
    order, removed = sorted(rows, key=lambda r: (-r[1], r[0])), set()
    for i, (e1, _) in enumerate(order):
        if i not in removed:
            removed |= {j for j in range(i + 1, len(order)) if order[j][0] in e1}
    got = {r.entity for r in N.collapsed(spark.createDataFrame(rows, "entity string, score double")).collect()}
    assert got - {""} == {e for i, (e, _) in enumerate(order) if i not in removed} - {""}


def test_extraction_with_back_off(spark):
    listed = [(i, "We like birds such as Robin, Finch and Wren.") for i in range(3)]
    near = [(i, "Kites fly. A Falcon is one of many raptors here.") for i in range(3)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, text string")
    sure = K.extracted(frame(listed), "birds")
    assert sure.confidence == 2 and {"robin", "finch", "wren"} <= {r.entity for r in sure.entities.collect()}
    unsure = K.extracted(frame(near), "raptors")
    assert unsure.confidence == 1 and any("falcon" in r.entity for r in unsure.entities.collect())
    none = K.extracted(frame(near), "zzz")
    assert none.confidence == 1 and none.entities.count() == 0
    assert K.general_queries('"Big Cats" list') == [("big cats", True), ("big cats", False), ("list", True), ("list", False)]
    assert [r.doc_id for r in K.hinted(frame([(1, "A LIST"), (2, "x"), (3, "Raptors"), (4, None)]), "raptors").collect()] == [1, 3]


def test_members_and_their_patterns(spark):
    names = ["robin", "finch", "wren", "heron", "eagle", "raven"]
    docs = spark.createDataFrame([(i, "We like birds such as Robin, Finch and Wren.") for i in range(3)], "doc_id int, text string")
    pages = spark.createDataFrame([(i, f"{i} list of birds <ul>" + "".join(f"<li{i}>{n}</li{i}>" for n in names) + "</ul>") for i in range(5)], "doc_id int, text string")
    found = K.members(docs, pages, "birds", how=Q.WAY)
    assert found.confidence == 3 and {"finch", "wren", "heron", "eagle"} <= {r.entity for r in found.entities.collect()}
    assert {r.entity for r in K.saved_members(found).collect()} == {"finch", "wren"}  # the others score nearly 0
    nothing = K.members(docs, pages.limit(0), "birds", how=Q.WAY)
    assert nothing.confidence == 2 and {"robin", "finch"} <= {r.entity for r in nothing.entities.collect()}


def test_alternating_expansion(spark):
    from setweave.operators import bilingual as B
    from setweave.operators import expansion as X
    from setweave.operators import patterns as P

    def side(lang, names):
        pages = spark.createDataFrame([(i, "".join(f"<b{i}>{n}</b{i}>" for n in names)) for i in range(3)], "doc_id int, text string")
        return B.Side(lang, X.SetExpander(pages, X.Expansion(P.Settings(bracket=2), "ETF", noisy=True)), X.SeedSelector("FSS_UNSUPERVISED", names[:2], n_true=2))

    es, en = side("es", ["rojo", "verde", "azul", "negro"]), side("en", ["red", "green", "blue", "pink"])
    words = {"azul": "blue", "verde": "green", "blue": "azul", "green": "verde", "negro": "black"}
    table = spark.createDataFrame(list(words.items()), "source string, target string")
    translate = lambda known, lang: known.join(table, known.entity == table.source).select("source", F.col("target").alias("entity"), F.lit(1.0).alias("score"))
    done = B.alternate(es, en, 4, translate)
    assert [d.lang for d in done] == ["es", "en", "es", "en"] and set(done[2].seeds) == {"azul", "verde"} and set(done[3].seeds) == {"blue", "green"}
    assert len(B.alternate(side("es", ["a1", "b1"]), side("en", ["c1"]), 4)) == 1
