import os

import pytest

from setweave.llm import mixing as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.VOCABULARY), reason="no vocabulary file")
DOCS, TARGETS = "doc_id bigint, source string, text string, tokens int, n int", "source string, target_share double, max_repeats int"


def docs(spark, sizes):
    rows = [(1000 * k + i, (f" {s.upper()}　", s, f"{s} ")[i % 3], "word " * (1 + (i * 7) % 40), 1, 1) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows + [(-1, None, "x y", 1, 1), (-2, "big", None, 1, 1), (-3, "big", "", 1, 1), (-4, "other", "a b c", 1, 1)], DOCS)


def test_shares_are_reached_within_a_document(spark):
    targets = spark.createDataFrame([("Big", 0.5, 1), ("small ", 0.3, 4), ("mid", 0.2, 2)], TARGETS)
    mix = M.mix(docs(spark, {"big": 600, "small": 60, "mid": 200}), targets, M.REACHABLE)
    got = {r.source: r for r in mix.shares.collect()}
    total = sum(r.tokens for r in got.values())
    limits = {"big": 1, "small": 4, "mid": 2}
    for name, r in got.items():
        assert abs(r.tokens - r.target_share * total) <= 41 and r.most_copies <= limits[name] and r.in_reach
    copies = mix.copies.collect()
    assert len({r.doc_id for r in copies}) == len(copies) and all(abs(r.copies - r.rate) < 1 + 1e-6 for r in copies)


def test_out_of_reach_and_missing(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("none", 0.2, 3)], TARGETS)
    df = docs(spark, {"big": 300, "small": 20})
    got = {r.source: r for r in M.mix(df, targets, total_tokens=5000).shares.collect()}
    assert not got["small"].in_reach and got["small"].tokens == 2 * got["small"].source_tokens
    assert not got["none"].in_reach and got["none"].tokens == 0 and abs(got["big"].tokens + got["small"].tokens - 5000) <= 41
    free = {r.source: r for r in M.mix(df, targets, M.REACHABLE).shares.collect()}
    assert free["small"].in_reach and abs(free["small"].reached_share - 0.375) < 0.02


def test_empty_tables_and_bad_targets(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    empty = M.mix(docs(spark, {}).limit(0), targets, M.ALL)
    assert empty.copies.count() == 0 and empty.shares.first().tokens == 0
    assert M.mix(docs(spark, {"big": 3}), targets.limit(0), 10).copies.count() == 0
    with pytest.raises(ValueError):
        M.mix(docs(spark, {"big": 3}), targets, "most")
    with pytest.raises(ValueError):
        M.mix(docs(spark, {"big": 3}), targets.union(targets), M.ALL)


def test_long_texts(spark):
    rows = [(1, "s", " " * 2_000_000 + "a"), (2, "s", "x" * 300_000), (3, "s", "山" * 100_000), (4, "s", "a  b")]
    got = {r.doc_id: r.tokens for r in M.count_tokens(spark.createDataFrame(rows, "doc_id int, source string, text string")).collect()}
    assert all(got.values()) and got[4] == len(M._encoding(M.VOCABULARY).encode_ordinary("a  b"))


def test_all_tokens(spark):
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.4, 2), ("mid", 0.2, 3)], TARGETS)
    got = {r.source: r for r in M.mix(docs(spark, {"big": 400, "small": 20, "mid": 100}), targets, M.ALL).shares.collect()}
    total = sum(r.source_tokens for r in got.values())
    assert [got[s].in_reach for s in ("big", "small", "mid")] == [True, False, True] and got["small"].tokens == 2 * got["small"].source_tokens
    assert abs(sum(r.tokens for r in got.values()) - total) <= 2 * 41 and abs(got["big"].tokens / got["mid"].tokens - 2) < 0.1


def test_what_others_lack_puts_nothing_out_of_reach(spark):
    """A source that gives all it has, and its share, is in reach, though it can't fill up what another one lacks."""
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 1), ("mid", 0.2, 9)], TARGETS)
    got = {r.source: r for r in M.mix(docs(spark, {"big": 360, "small": 60, "mid": 260}), targets, M.ALL).shares.collect()}
    assert [got[s].in_reach for s in ("big", "small", "mid")] == [True, False, True] and got["big"].reached_share >= 0.5


def test_nearer_side(spark):
    """Of single tokens exactly as many are used as are wanted; of large documents the nearer number."""
    single = spark.createDataFrame([(i, "s", "a") for i in range(1000)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("s", 1.0, 1)], TARGETS)
    for want in (1, 333, 999, 1000):
        assert M.mix(single, targets, want).shares.first().tokens == want
    size = len(M._encoding(M.VOCABULARY).encode_ordinary("word " * 10))
    large = single.selectExpr("doc_id", "source", "repeat('word ', 10) AS text").limit(20)
    assert M.mix(large, targets, 7 * size + size * 6 // 10).shares.first().tokens == 8 * size
    assert M.mix(large, targets, 7 * size + size * 4 // 10).shares.first().tokens == 7 * size


@pytest.mark.parametrize("end", ["", "a", "\n", " a", "\na", "7", "!", "\u3000山", " "])
@pytest.mark.parametrize("run", [" ", "\n", " \n", "\t  "])
def test_long_white_space_counts_as_the_tokenizer_does(run, end):
    e = M._encoding(M.VOCABULARY)
    for start in ("", "x", "x.", "x ", "7"):
        text = start + run * 700 + end
        assert M.n_tokens(text, e) == len(e.encode_ordinary(text))
