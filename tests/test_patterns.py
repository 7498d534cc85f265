import random
from collections import defaultdict

import pytest

from setweave.operators import patterns as P

NAV = 'x>\n<html lang="en"><body><nav><ul><li><a href="/Nicht">Nicht</a></li><li><a href="/aulich">aulich</a></li><li><a href="/für">für</a></li><li><a href="/sch">sch</a></li><li><a href="/erüver">erüver</a></li><li><a href="/enau">enau</a></li></ul></nav></body>'
TABLE = "<table><tr><td>ford</td><td>usa</td></tr><tr><td>toyota</td><td>japan</td></tr><tr><td>fiat</td><td>italy</td></tr><tr><td>kia</td><td>korea</td></tr></table>"


def found(page, seeds, **options):
    settings = P.Settings(stopwords=(), **options)
    known = P.Seeds(seeds)
    return list(P.patterns_of(page, known, settings, P.ContentFilter(settings, known.shortest)))


def test_navigation_list():
    got = {(p["left"], p["right"]): [c["arg1"] for c in p["contents"]] for p in found(NAV, ["aulich", "für"], bracket=2)}
    between = '</a></li><li><a href="/'
    assert got == {('">', between): sorted(["nicht", "aulich", "für", "sch", "erüver"]), (between, '">'): sorted(["aulich", "für", "sch", "erüver", "enau"])}


def test_pairs_in_a_table():
    (p,) = found(TABLE, [("ford", "usa"), ("toyota", "japan")], bracket=2)
    assert (p["left"], p["middle"], p["right"], p["ctx_len"], p["reversed"]) == ("><tr><td>", "</td><td>", "</td></tr><tr><td>", 36, False)
    assert [(c["arg1"], c["arg2"]) for c in p["contents"]] == [("fiat", "italy"), ("ford", "usa"), ("toyota", "japan")]
    assert found(TABLE.replace("<tr><td>kia</td><td>korea</td></tr>", ""), [("ford", "usa"), ("toyota", "japan")], bracket=2) == []
    (r,) = found(TABLE, [("usa", "ford"), ("japan", "toyota")], bracket=2)
    assert r["reversed"] and ("italy", "fiat") in [(c["arg1"], c["arg2"]) for c in r["contents"]]


def occ(*rows):
    return [P.Occurrence(s, left[::-1], right) for left, right, s in rows]


def test_contexts_by_hand():
    got = P.contexts(occ(("ef", "at", 1), ("ef", "aq", 2), ("uf", "at", 2)), P.Settings(bracket=2))
    assert {(x[0], x[3]) for x in got} == {("ef", "a"), ("f", "at")}


def brute(rows, need):
    """All pairs of contexts by the definition: longest on one side before any single character of the other."""
    seeds = lambda a, b: len({s for left, right, s in rows if left.endswith(a) and right.startswith(b)})
    lefts = {left[i:] for left, _, _ in rows for i in range(len(left))}
    rights = {right[:i] for _, right, _ in rows for i in range(1, len(right) + 1)}
    tops_l, tops_r = {x[-1] for x in lefts}, {x[0] for x in rights}
    out = set()
    ok = {a for a in lefts if any(seeds(a, t) >= need for t in tops_r)}
    for a in ok:
        if not any(len(b) > len(a) and b.endswith(a) for b in ok):
            fit = {b for b in rights if seeds(a, b) >= need}
            out |= {(a, b) for b in fit if not any(len(c) > len(b) and c.startswith(b) for c in fit)}
    ok = {b for b in rights if any(seeds(t, b) >= need for t in tops_l)}
    for b in ok:
        if not any(len(c) > len(b) and c.startswith(b) for c in ok):
            fit = {a for a in lefts if seeds(a, b) >= need}
            out |= {(a, b) for a in fit if not any(len(c) > len(a) and c.endswith(a) for c in fit)}
    return out


def test_contexts_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        rows = [("".join(rng.choice("ab<") for _ in range(rng.randrange(1, 6))), "".join(rng.choice("ab<") for _ in range(rng.randrange(1, 6))), rng.randrange(3)) for _ in range(rng.randrange(2, 9))]
        if len({s for *_, s in rows}) < 2:
            continue
        for need in (2, 3):
            assert {(x[0], x[3]) for x in P.contexts(occ(*rows), P.Settings(bracket=need))} == brute(rows, need)


@pytest.mark.parametrize("bracket,weights,most", [(0, {}, 3), (-1, {}, 3), (2, {}, 2), (-2, {0: 5.0, 1: 5.0, 2: -0.1}, 2)])
def test_bracketing(bracket, weights, most):
    rows = occ(("xa", "b1", 0), ("xa", "b2", 1), ("ya", "b3", 2))
    got = P.contexts(rows, P.Settings(bracket=bracket, weights=weights))
    assert got and min(len(x[4]) for x in got) == most


def test_seed_expressions():
    assert P.re.fullmatch(P.literal("J. R. O'Neil"), "J R O-Neil", P.re.I)
    assert P.re.fullmatch(P.literal("new york"), "NEW__York", P.re.I)
    assert [P.Seeds(["ab", "abc", "AB"]).rows[i][0] for i, *_ in P.Seeds(["ab", "abc", "AB"]).expressions] == ["abc", "AB"]


def test_levels_and_extraction():
    good = P.ContentFilter(P.Settings(stopwords=("the",)), 2)
    assert [c[0] for c in P.extract("<b>aa</b><b><b>bb</b> <b>the</b><b>1</b>", "<b>", "</b>", 2, good)] == ["aa", "bb"]
    assert P.strict_enough("<a>", None, "x</a>", 41) and not P.strict_enough("<a>x", None, "</a>", 40)
    assert found(NAV, ["aulich", "für"], bracket=2, html_level=44) == []


def test_frame(spark):
    pages = spark.createDataFrame([(1, NAV, "c"), (2, None, "c"), (3, "", "c"), (4, "aulich only", "c"), (5, NAV * 50, "c"), (1, NAV, "c")], "doc_id bigint, text string, contents string")
    got = P.extractions(P.induce(pages, ["aulich", "für", "nothing"], P.Settings(stopwords=())))
    tf = defaultdict(int)
    for r in got.where("doc_id = 1").collect():
        tf[r.arg1] += r.tf
    assert tf == {"aulich": 4, "für": 4, "sch": 4, "erüver": 4, "nicht": 2, "enau": 2}
    assert P.induce(pages.limit(0), ["a1", "b1"]).count() == 0
    assert P.seed_occurrences(pages.where("doc_id < 5"), ["aulich"]).count() == 4
    uni = P.induce(pages.where("doc_id = 1").limit(1), ["aulich"], P.Settings(stopwords=(), uniseed=True))
    assert uni.count() > 0


def test_seeds_that_share_their_longest_word(spark):
    page = "<table>" + "".join(f"<tr><td>{n}</td><td>{i}</td></tr>" for i, n in enumerate(["usa", "fort zabuso", "japan", "zabuso 95", "north kelu"])) + "</table>"
    seeds = ["fort zabuso", "zabuso 95", "lone mirefa"]
    known = P.Seeds(seeds)
    settings = P.Settings(stopwords=(), bracket=2)
    want = list(P.patterns_of(page, known, settings, P.ContentFilter(settings, known.shortest)))
    got = P.induce(spark.createDataFrame([(1, page)], "doc_id bigint, text string"), seeds, settings).collect()
    assert want and {(r.left, r.right) for r in got} == {(p["left"], p["right"]) for p in want}


def test_rounds_that_reuse_pages(spark):
    from setweave.operators import expansion as X

    page = lambda i, names: (i, "".join(f"<b{i}>{n}</b{i}>" for n in names))
    rows = [page(1, ["seed1", "seed2", "found1", "found2", "x"]), page(2, ["y", "found1", "found2", "other1", "z"])]
    pages = spark.createDataFrame(rows, "doc_id int, text string")
    run = lambda reuse: {r.entity for r in X.iterate(pages, X.SeedSelector("FSS_UNSUPERVISED_V2", ["seed1", "seed2"], n_true=2), 2, X.Expansion(P.Settings(bracket=2), "ETF", noisy=True), reuse=reuse).collect()}
    assert run(True) <= run(False) and "other1" not in run(True)
