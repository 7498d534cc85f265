import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from setweave.llm import together as T

SCHEMA = "row_key string, column_key string, cell_value double, i string, n int"


def brute(rows, shared, lift):
    cols = {}
    for r, c, *_ in rows:
        if r is not None and c is not None:
            cols.setdefault(r, set()).add(c)
    n = len(set().union(*cols.values())) if cols else 0
    out = {}
    for a, b in combinations(sorted(cols, key=str.encode), 2):
        k = len(cols[a] & cols[b])
        if k >= shared and k * n >= lift * len(cols[a]) * len(cols[b]):
            out[a, b] = (k, len(cols[a]), len(cols[b]), n)
    return out


def cells(seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(60)}", f"c{int(rng.paretovariate(0.7)) % 150}", 1.0, "x", 1) for _ in range(1500)]
    for g in range(12):  # planted groups
        rows += [(f"é{g}-{m}", f"p{g}-{j}", 1.0, None, None) for m in range(3) for j in range(6)]
    rows += [("hot", f"c{j}", 1.0, "x", 1) for j in range(150)] + [(f"k{j}", "wide", 1.0, "x", 1) for j in range(60)] * 2
    return rows + [(None, "c1", 1.0, "x", 1), ("k1", None, 1.0, "x", 1), ("", "c1", None, "x", 1)] + rows[:50]


@pytest.mark.parametrize("wide,lift,shared,per_task", [(T.WIDE, 10, 5, T.PER_TASK), (8, 1, 5, 50), (8, 1, 2, 500), (3, 2, 3, 100), (8, 1, 1, 100)])
def test_against_brute_force(spark, wide, lift, shared, per_task):
    rows = cells(lift)
    got = T.co_occurrence(spark.createDataFrame(rows, SCHEMA), min_shared=shared, min_lift=lift, wide=wide, per_task=per_task).collect()
    assert {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in got} == brute(rows, shared, lift)
    for r in got[:20]:
        table = np.array([[r.n_ab, r.n_a - r.n_ab], [r.n_b - r.n_ab, r.n - r.n_a - r.n_b + r.n_ab]], float)
        expected = table.sum(1)[:, None] * table.sum(0) / table.sum()
        llr = 2 * sum(k * math.log(k / e) for k, e in zip(table.ravel(), expected.ravel()) if k)
        assert abs(r.llr - llr) < 1e-6 * max(1, llr)


def test_empty(spark):
    assert T.co_occurrence(spark.createDataFrame([], SCHEMA)).count() == 0


def special(*rows):
    return pa.array([[dict(zip(("i", "pieces", "wide"), r)) for r in rows]], pa.list_(pa.struct([("i", pa.int64()), ("pieces", pa.int32()), ("wide", pa.int32())])))


def entries(batches):
    out = {}
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("item", "piece", "neighbours", "counts", "more")]
        for i, piece, js, ks, more in zip(*cols):
            assert js == sorted(js)
            for j, k, m in zip(js, ks, more or [0] * len(js)):
                n, pieces = out.get((i, j), (0, {(piece, m)}))
                out[i, j] = n + k, pieces | {(piece, m)}
    return out


def test_stripes_add_up():
    lists = [[5, 1, 3], [1, 3], [9], [], [3, 5, 1, 9]]
    none = special().take(pa.array([0] * len(lists)))
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64())), none], ["items", "special"])
    want = {}
    for x in lists:
        for i in x:
            for j in x:
                if i <= j:
                    want[i, j] = want.get((i, j), 0) + 1
    assert {k: n for k, (n, _) in entries(T._stripes_of_groups(iter([batch]))).items()} == want


def test_hot_stripes_are_split_and_merged():
    items = list(range(200))
    batch = pa.RecordBatch.from_arrays([pa.array([items] * 3, pa.list_(pa.int64())), pa.concat_arrays([special((0, 7, 2), (1, 1, 4))] * 3)], ["items", "special"])
    stripes = list(T._stripes_of_groups(iter([batch])))
    got = entries(stripes)
    assert len({p for (i, _), (_, ps) in got.items() if i == 0 for p, _ in ps}) == 7 and all(len(ps) == 1 for _, ps in got.values())
    assert got[0, 1][1] == {(got[0, 1][1].copy().pop()[0], 2)} and {m for (_, j), (_, ps) in got.items() if j > 1 for _, m in ps} == {0}
    table = pa.Table.from_batches(stripes).sort_by([("item", "ascending"), ("piece", "ascending")])
    pairs = [r for b in T._merge(5)(iter(table.to_batches(max_chunksize=20))) for r in b.to_pylist()]
    assert {(r["a"], r["b"]) for r in pairs} == {(i, i) for i in items} | {(0, 1)}
    assert len(T._merge(3)(iter(table.to_batches())).__next__()) == 200 * 201 // 2


def test_column_of_100_000_items(spark):
    """A column that holds a third of all rows costs no pairs: nobody shows it, and no task gathers it."""
    n, step = 100_000, 20
    wide = spark.range(n).selectExpr("concat('e', id) AS row_key", "'everyone' AS column_key")
    own = spark.range(n).selectExpr("concat('e', id) AS row_key", f"explode(transform(sequence(0, 4), x -> concat('c', (id div {step}) * 5 + x))) AS column_key").where(f"crc32(concat(row_key, column_key)) % {step} < 3")
    hits = spark.range(0, n, step * 10).selectExpr(f"explode(array(id, id + 1)) AS id", f"id AS g").selectExpr("concat('e', id) AS row_key", "explode(transform(sequence(0, 3), x -> concat('h', g, '-', x))) AS column_key")
    spark.sparkContext._jvm.System.gc()
    got = T.co_occurrence(wide.unionByName(own).unionByName(hits), min_shared=5, min_lift=1).collect()
    assert {(r.item_a, r.item_b) for r in got} >= {tuple(sorted((f"e{g}", f"e{g + 1}"))) for g in range(0, n, step * 10)}
    stored = T.stash(wide.unionByName(own), "t")
    shown = T._wide_groups(stored.select(T.item_key(F.col("row_key"), 0).alias("i"), *T.group_key(F.col("column_key"))), *[stored.groupBy(*T.group_key(F.col("column_key"))).agg(F.count(F.lit(1)).alias("w"))], 1024, 5)[1]
    assert shown.count() == n and shown.where("NOT hidden").count() == 0


def test_wide_columns_meet_in_blocks(spark):
    """Items in more wide columns than they may hide meet in those they show, block by block."""
    rng = random.Random(5)
    rows = [(f"e{i}", f"w{j}") for i in range(300) for j in range(9) if rng.random() < 0.8] + [(f"e{i}", f"c{rng.randrange(400)}") for i in range(300) for _ in range(6)]
    got = T.co_occurrence(spark.createDataFrame(rows, "row_key string, column_key string"), min_shared=7, min_lift=1, wide=40, per_task=2000).collect()
    assert {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in got} == brute(rows, 7, 1)
