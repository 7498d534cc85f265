import random
import unicodedata

import numpy as np
import pytest

from setweave.llm import leakage as L

DOCS, ITEMS = "doc_id bigint, text string, lang string, length int", "item_id bigint, lang string, task string, text string"


def units(text, by_character):
    text = (text or "").lower()
    cat = [unicodedata.category(c)[0] for c in text]
    if by_character:
        return [c for c, k in zip(text, cat) if k in "LN"]
    return "".join(c if k in "LNM" else " " for c, k in zip(text, cat)).split()


def brute(docs, items, words=12, chars=24):
    out = {}
    for item, lang, _, text in items:
        by = lang in L.BY_CHARACTER
        k, a = (chars if by else words), units(text, by)
        grams = {tuple(a[i : i + k]) for i in range(len(a) - k + 1)}
        for doc, body, *_ in docs:
            b = units(body, by)
            if item is not None and any(tuple(b[i : i + k]) in grams for i in range(len(b) - k + 1)):
                best = max(n for i in range(len(a)) for j in range(len(b)) if (n := _same(a, b, i, j)))
                out[item, doc] = best
    return out


def _same(a, b, i, j):
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return n


def tables(rng):
    vocabulary = [f"w{i}é" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    kana = [chr(0x3042 + i) for i in range(20)]
    cjk = lambda n: "".join(rng.choice(kana) for _ in range(n))
    items = [(i, "en", "qa", text(rng.randrange(5, 40))) for i in range(12)] + [(20 + i, ("ja", "zh-CN")[i % 2], "qa", cjk(rng.randrange(20, 60))) for i in range(6)]
    items += [(30, "en", "qa", None), (31, None, "qa", ""), (32, "hi", "qa", " ".join(["किताब", "की", "दुनिया"] * 5)), (None, "en", "qa", text(20))]
    docs = []
    for d in range(60):
        body = [text(rng.randrange(30)), cjk(rng.randrange(30))]
        item = rng.choice(items)
        if item[3]:
            u = units(item[3], item[1] in L.BY_CHARACTER)
            a = rng.randrange(len(u))
            part = u[a : a + rng.randrange(5, 45)]
            body.insert(rng.randrange(3), ("、\n" if item[1] in L.BY_CHARACTER else rng.choice([" ", ",\n", "_", " -- "])).join(part).upper())
        docs.append((d, " new ".join(body), "x", 1))
    return docs + [(100, None, "x", 1), (101, "", "x", 1), (102, "w1é " * 3000, "x", 1), (5, docs[5][1], "x", 1)], items


@pytest.mark.parametrize("shard,block", [(L.SHARD_TOKENS, L.BLOCK_BYTES), (50, 1000)])
def test_against_brute_force(spark, shard, block):
    docs, items = tables(random.Random(shard))
    got = L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), shard_tokens=shard, block_bytes=block).collect()
    assert {(r.item_id, r.doc_id): r.length for r in got} == brute(docs, items)


def test_empty_and_clean(spark):
    docs, items = tables(random.Random(9))
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0
    dirty = {doc for _, doc in brute(docs, items)}
    assert sorted(r.doc_id for r in L.decontaminated(d, i).collect()) == sorted(x[0] for x in docs if x[0] not in dirty)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for depth in (1, 2, 3, 5, 12):
        tokens = rng.integers(0, 4, 400).astype(np.int32)
        room = L._room(tokens)
        want = sorted((i for i in range(400) if room[i] >= depth), key=lambda i: (tuple(tokens[i : i + depth]), i))
        assert L.suffix_array(tokens, depth).tolist() == want


def test_many_items_with_one_beginning(spark, monkeypatch):
    """Equal suffixes are one class; matches are extended in parts, and blocks don't add passes over the corpus."""
    monkeypatch.setattr(L, "MATCHES", 100)
    start = " ".join(f"s{i}" for i in range(15))
    items = [(i, "en", "qa", f"{start} end{i} of it") for i in range(60)]
    docs = [(d, f"new {start} end{d} of it old {start}" if d < 60 else f"x {start}", "x", 1) for d in range(80)]
    probe = L.Probe([(i, t) for i, _, _, t in items], 12, False)
    assert len(probe.order) == 60 * 7 and len(probe.classes) == 4 + 60 * 3
    found = L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_bytes=500)
    got = {(r.item_id, r.doc_id): (r.length, r.n_places) for r in found.collect()}
    assert got == {(i, d): (18 if i == d else 15, 2 if d < 60 else 1) for i in range(60) for d in range(80)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_one_item_repeated(spark):
    items = spark.createDataFrame([(1, "en", "qa", " ".join(map(str, range(20))))] * 500, ITEMS)
    docs = spark.createDataFrame([(1, " ".join(map(str, range(3, 18))), "x", 1)], DOCS)
    assert [(r.length, r.n_places, r.item_place) for r in L.leaks(docs, items, block_bytes=200).collect()] == [(15, 1, 3)]
