import datetime as dt
import random
from statistics import NormalDist

import pytest

from setweave.llm import fusion as U

SCHEMA = "list_id bigint, entity_id bigint, entity string, a double, b double, scored_at timestamp, p double, z double"
NAN, INF = float("nan"), float("inf")


def brute(rows, scores=("a", "b")):
    last = {}
    for li, e, _, a, b, at, _, _ in rows:
        if li is None or e is None:
            continue
        if (li, e) not in last or at >= last[li, e][0]:
            last[li, e] = (at, {"a": a, "b": b})
    out = {}
    for li, e in last:
        zs = []
        for s in scores:
            vs = [v for (k, _), (_, r) in last.items() if k == li and (v := r[s]) is not None and v == v and abs(v) != INF]
            v = last[li, e][1][s]
            if v in vs:
                zs.append(NormalDist().inv_cdf((sum(x < v for x in vs) + vs.count(v) / 2) / len(vs)))
        if zs:
            out[li, e] = sum(zs) / len(zs)
    return out


@pytest.mark.parametrize("split", [U.SPLIT_ABOVE, 3])
def test_against_brute_force(spark, split):
    rng = random.Random(1)
    t = dt.datetime(2024, 1, 1)
    rows = [(li, e, None, rng.choice([rng.gauss(0, 10), 5.0, None, NAN, INF, -INF]), 10 ** rng.uniform(-9, 9), t + dt.timedelta(days=rng.randrange(3), seconds=i), 0.0, 1.0) for i, (li, e) in enumerate((li, e) for li in (1, 2) for e in range(30) for _ in range(2))]
    rows += [(3, 1, "one", 7.0, None, t, 0.0, 0.0), (4, 1, "none", None, NAN, t, 0.0, 0.0), (5, 1, "", 0.0, -0.0, t, 0, 0), (5, 2, "", -0.0, 0.0, t, 0, 0), (None, 1, "", 1.0, 1.0, t, 0, 0)]
    rows += [rows[0]]
    got = {(r.list_id, r.entity_id): r.score for r in U.fuse(spark.createDataFrame([(*r[:6], float(r[6]), float(r[7])) for r in rows], SCHEMA), {"a": 1.0, "b": 1.0}, split_above=split, pieces=4).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_empty_weights_and_ties(spark):
    assert U.fuse(spark.createDataFrame([], SCHEMA), {"a": 1.0}).count() == 0
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, e, "", float(e), -float(e), t, 0.0, 0.0) for e in range(5)], SCHEMA)
    equal, first = U.best(U.fuse(df, {"a": 1.0, "b": 1.0}), 3), U.best(U.fuse(df, {"a": 3.0, "b": 1.0}), 2)
    assert [r.entity_id for r in equal.orderBy("rank").collect()] == [0, 1, 2]
    assert [r.entity_id for r in first.orderBy("rank").collect()] == [4, 3]


def test_normal_quantile(spark):
    ps = [1e-300, 1e-12, 1e-5, 0.01, 0.075, 0.2, 0.5, 0.9, 0.999999, 1 - 1e-12]
    got = [r.z for r in spark.createDataFrame([(p,) for p in ps], "p double").selectExpr(f"{U.normal_quantile_sql('p')} AS z").collect()]
    assert all(abs(z - NormalDist().inv_cdf(p)) <= 1e-9 * max(1, abs(z)) for p, z in zip(ps, got))
