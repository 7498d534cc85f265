import re
import string
import unicodedata

from setweave.llm import spellings as S

SCHEMA = "ext_id bigint, content string, h1 string, form int"
ROWS = [
    "New York", " new-york!", "NEW YORK", "n.e.w y’o“r”k", "a::b", "B :: A.", "ab", "a::", "::a", "a", "A", "", None, "...", "  ", "3°", "3", "Ａ", "чай", "ЧАЙ", "чаи", "x::y::z", "y::z::X", "x" * 50000, "X" * 50000, "東、京", "東京", "$5", "5", "é", "e", "a_b", "a b", "a+b", "‐a—b", "٣", "３",
]


def form(text):
    if text is None or not any(unicodedata.category(c)[0] in "LN" for c in text):
        return None
    keep = lambda x: "".join(c for c in x if not (c.isspace() or unicodedata.category(c)[0] == "P" or c in string.punctuation))
    return tuple(sorted(keep(x) for x in text.lower().split("::", 1)))


def test_against_brute_force(spark):
    rows = [(i, c, "clash", 1) for i, c in enumerate(ROWS + ROWS[:4])] + [(2, "NEW YORK", "again", 1), (None, "New York", "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    groups = {}
    for i, c, _, _ in rows:
        if i is not None and form(c) is not None:
            groups.setdefault(form(c), []).append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(r) for r in S.redundant(df).collect()} == want
    got = {(r.keep_id, r.n_copies) for r in S.collapse(df).where("NOT collided").collect()}
    assert got == {(min(g), len(g)) for g in groups.values()}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.redundant(df).count() == 0 and S.collapse(df).count() == 0


def test_ignored_characters_are_those_of_the_definition(spark):
    points = [chr(o) for o in range(1, 0x3100) if unicodedata.category(chr(o)) not in ("Cn", "Cs")]
    df = spark.createDataFrame([(c,) for c in points], "c string").selectExpr("c", f"regexp_replace(c, r'{S.IGNORED}', '') = '' AS gone")
    odd = [r.c for r in df.collect() if r.gone != (r.c.isspace() and not "\x1c" <= r.c <= "\x1f" or unicodedata.category(r.c)[0] == "P" or r.c in string.punctuation)]
    assert not re.sub(r"[\x1c-\x1f]", "", "".join(odd))


def test_folded_characters(spark):
    rows = [(1, "Straße"), (2, "STRASSE"), (3, "ﬁx"), (4, "FIX"), (5, "ＡＢ"), (6, "a b"), (7, "café"), (8, "cafe\u0301"), (9, None), (10, "ΣΊΣΥΦΟΣ"), (11, "σίσυφος")]
    df = spark.createDataFrame(rows, "ext_id bigint, content string")
    pairs = lambda fold: sorted((r.keep_id, r.dup_id) for r in S.redundant(df, fold=fold).collect())
    assert pairs(True) == [(1, 2), (3, 4), (5, 6), (7, 8), (10, 11)]
    assert pairs(False) == [(10, 11)] or pairs(False) == []
    assert sorted(r.n_copies for r in S.collapse(df, fold=True).collect()) == [2] * 5
