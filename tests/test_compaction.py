import datetime as dt
import posixpath

import pytest

from setweave.sources import compaction as C

SCHEMA = "file_id bigint, url string, size_bytes bigint, modified_at timestamp, payload string, path string, n string"


def listing(spark, rows):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, u, len(p or ""), at, p, "clash", "x") for i, u, p in rows], SCHEMA)


def brute(rows):
    files = {}
    for i, u, p in rows:
        if i is not None and u is not None and posixpath.normpath(u).rsplit(".", 1)[-1] in C.EXTENSIONS:
            files.setdefault(posixpath.normpath(u), []).append((i, p))
    out = []
    for copies in files.values():
        content = min(copies)[1] or ""
        lines = content.replace("\r\n", "\n").split("\n")
        out += [(min(i for i, _ in copies), k + 1) for k, x in enumerate(lines) if k and "\t" in x]
    return sorted(out)


ROWS = [
    (5, "c/1/a.txt", "u\tw\nl\tx\tr\n\nl\ty\tr"), (3, "c/./1/a.txt", "u\tw\nl\tx\tr\n\nl\ty\tr"), (7, "c//1/b.html", "u\tw\r\nl\tx\tr\r\n"),
    (9, "c/1/A.txt", "u\tw\nl\tx\tr"), (10, "c/1/a.TXT", "u\tw\nl\tx\tr"), (11, "c/2/../1/d.htm", "u\tw"), (12, "c/e.txt", None), (13, "c/f.txt", ""),
    (14, None, "u\tw\nl\tx\tr"), (None, "c/g.txt", "u\tw\nl\tx\tr"), (15, "c/h.gif", "u\tw\nl\tx\tr"), (16, "c/long.txt", "u\tw\n" + "l\tx\tr\n" * 5000), (17, "c/same.txt", "u\tw\nl\tx\tr\n\nl\ty\tr"),
]


@pytest.mark.parametrize("target,per_block", [(10, 3), (C.TARGET_BYTES, 100_000)])
def test_store_holds_each_record_once(spark, tmp_path, target, per_block):
    store = C.consolidate(spark, listing(spark, ROWS + ROWS[:3]), str(tmp_path / "store"), target, per_block)
    got = C.read_store(spark, store)
    assert sorted((r.file_id, r.line_no) for r in got.collect()) == brute(ROWS)
    assert store.n_records == got.count()


def test_groups_are_intervals_of_the_running_sum(spark):
    rows = [(i, f"d/{i}.txt", "x" * (i % 7 * 10)) for i in range(200)]
    plan = C.plan_groups(C.freeze_manifest(listing(spark, rows)), 300, 20).toPandas().sort_values("start_byte", kind="stable")
    assert len(plan) == 200 and plan.bytes.sum() == sum(len(p) for _, _, p in rows)
    assert (plan.start_byte // 300 == plan.group_id).all()
    ends = plan.assign(end=plan.start_byte + plan.bytes)[plan.bytes > 0]
    assert (ends.start_byte.to_numpy()[1:] == ends.end.to_numpy()[:-1]).all()
    assert ends.groupby("group_id").bytes.sum().max() <= 300 + 60


def test_one_path_listed_very_often(spark, tmp_path):
    rows = [(i, ("c/a.txt", "c//a.txt", "./c/a.txt")[i % 3], f"u\tw\nl\t{i % 2}\tr") for i in range(C.OFTEN * 3)] + [(7, "c/a.txt", "u\tw\nl\t1\tr")] * 200 + ROWS
    store = C.consolidate(spark, listing(spark, rows), str(tmp_path / "store"), 10)
    assert sorted((r.file_id, r.line_no) for r in C.read_store(spark, store).collect()) == brute(rows)


def test_latest_version_counts_and_sizes_come_from_payloads(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "a.txt", None, at(1), "u\tw\nold\tx\tr", "", ""), (2, "./a.txt", 0, at(2), "u\tw\nnéw\ty\tr\nl\tz\tr", "", ""), (3, "a.txt", 5, None, "u\tw\nnull\tx\tr", "", ""), (4, "b.txt", -3, at(1), None, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.path: (r.file_id, r.row_id, r.bytes, r.n_records) for r in C.freeze_manifest(df).collect()}
    assert got == {"a.txt": (1, 2, len(rows[1][4].encode()), 2), "b.txt": (4, 4, 0, 0)}
    store = C.read_store(spark, C.consolidate(spark, df))
    assert sorted((r.file_id, r.record) for r in store.collect()) == [(1, "l\tz\tr"), (1, "néw\ty\tr")]


def test_lost_records_are_noticed_and_the_store_is_deleted(spark, tmp_path, monkeypatch):
    out, real = tmp_path / "store", C.records_of
    monkeypatch.setattr(C, "records_of", lambda *a: real(*a).where("line_no <> 3"))
    with pytest.raises(RuntimeError):
        C.consolidate(spark, listing(spark, ROWS), str(out))
    assert not out.exists()


def test_payloads_are_shuffled_once(spark):
    df = listing(spark, ROWS)
    plan = C.plan_groups(C.stash(C.freeze_manifest(df), "m"), 10, 3)
    shown = C.records_of(C.stash(plan, "p"), df, 8)._jdf.queryExecution().executedPlan().toString()
    main = [x for x in shown.split("\n") if "Exchange" in x and "content" in x]
    assert sum("REPARTITION" in x for x in shown.split("\n")) == 1 and "SortMergeJoin" not in shown, (main, shown)


def test_folder_tree(spark, tmp_path):
    for name, text in {"a/x.txt": "u\tw\nl\tx\tr", "a/b/y.html": "u\tw\r\nl\té\tr\r\n", "a/z.gif": "u\tw\nl\tx\tr", "e.txt": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    store = C.read_store(spark, C.consolidate(spark, C.listing_of_tree(spark, str(tmp_path))))
    assert sorted((r.line_no, r.record) for r in store.collect()) == [(2, "l\tx\tr"), (2, "l\té\tr")]


def test_empty_listing(spark, tmp_path):
    store = C.consolidate(spark, listing(spark, [])), str(tmp_path / "s")
    assert store[0].n_records == 0 and C.read_store(spark, store[0]).count() == 0


def test_paths(spark):
    cases = {"a/b.txt": "a/b.txt", "./a//b.txt": "a/b.txt", "a/x/../b.txt": "a/b.txt", "/../a.txt": "/a.txt", "../a.txt": "../a.txt", "../../a.txt": "../../a.txt", "a/..//b": "b", "": "", None: None, "/a/./b/": "/a/b"}
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.p for r in df.select("url", C.resolved_path(df.url).alias("p")).collect()} == cases
