"""Induction of extraction patterns from pages, and extraction with them.

A pattern is a pair of contexts ``left``, ``right`` (with ``middle`` for entity pairs) that brackets several given
entities on one page; whatever else it brackets there is a candidate. Pages are independent of each other, so all of it
is one pass over the pages without any shuffle: the scan drops pages that can't hold enough seeds (in the JVM), an Arrow
function works on a page's occurrences of the seeds, and only patterns and contents leave it, never the page's text.

Contexts are compared as sorted lists of strings, where a common prefix of a run is that of its first and last member.
Only those pairs of contexts count that can't be made longer without losing seeds.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.functions import text as T

CONTEXT = 100
#: Bad contents to good ones from which the rest of a page is given up for a pattern.
BAD_TO_GOOD = 100
UNISEED_LENGTHS = (32, 16, 8, 4, 2)


@dataclass(frozen=True)
class Settings:
    """Parameters of induction; ``bracket`` > 0 is the least number of seeds, 0 all that are on the page, -1 the most
    that any pair of contexts brackets, -2 the greatest weight that any brackets."""

    lang: str = "un"
    bracket: int = -1
    min_context: int = 1
    html_level: int = 0
    stopwords: Sequence[str] = tuple(T.STOPWORDS)
    phrases: Sequence[str] = ()
    weights: dict = field(default_factory=dict)
    uniseed: bool = False


@dataclass(frozen=True)
class Occurrence:
    """A seed on a page: its number, the reversed text before it, the text after it; for pairs what is between."""

    seed: int
    left: str
    right: str
    middle: str | None = None
    reversed: bool = False


def literal(seed: str) -> str:
    """A seed as a regular expression: optional characters may be missing, spaces and apostrophes vary."""
    out = []
    for piece in re.findall(rf"[{re.escape(T.OPTIONAL)}]|[\s']+|[^{re.escape(T.OPTIONAL)}\s']+", seed):
        out.append(".?" if piece in T.OPTIONAL else r"[\s_'-]+" if re.fullmatch(r"[\s']+", piece) else re.escape(piece))
    return "".join(out)


class Seeds:
    """Seeds and their expressions, the longest first; a seed that another's expression covers is left out."""

    def __init__(self, seeds: Iterable[str | tuple[str, str]]):
        rows = [(s, None) if isinstance(s, str) else tuple(s) for s in seeds]
        rows = [r for r in dict.fromkeys(rows) if r[0]]
        self.rows = sorted(rows, key=lambda r: (-len(r[0]) - len(r[1] or ""), r[0], r[1] or ""))
        self.names = [canonical(*r) for r in self.rows]
        self.expressions: list[tuple[int, re.Pattern, bool]] = []
        covered: list[re.Pattern] = []
        for i, (a, b) in enumerate(self.rows):
            if b is None:
                if any(p.fullmatch(a) for p in covered):
                    continue
                covered.append(re.compile(literal(a), re.I | re.S))
                self.expressions.append((i, covered[-1], False))
            else:
                x, y = literal(a), literal(b)
                between = rf"((?:(?!{x}|{y}).)+?)"
                self.expressions += [(i, re.compile(x + between + y, re.I | re.S), False), (i, re.compile(y + between + x, re.I | re.S), True)]

    @property
    def shortest(self) -> int:
        return min((len(x) for r in self.rows for x in r if x), default=T.MIN_LENGTH)

    def tokens(self) -> list[str]:
        """For each seed a piece of lower-case text that a page with it holds."""
        out = []
        for r in self.rows:
            for x in r:
                if x:
                    parts = re.findall(rf"[^{re.escape(T.OPTIONAL)}\s'_-]+", x.lower()) or [x.lower()]
                    out.append(max(parts, key=len))
        return out


def canonical(a: str, b: str | None = None) -> tuple[str, str | None]:
    return tidy(a), None if b is None else tidy(b)


_RUNS, _RUNS_CS = re.compile(rf"[{T.SPACE}_-]+"), re.compile(rf"[{T.SPACE}_]+")
_ENDS = re.compile(rf"^{T.PUNCT}+|{T.PUNCT}+\Z")
_SPLIT_S, _LAST_S = re.compile(" s "), re.compile(r" s\Z")


def tidy(s: str, case_sensitive: bool = False) -> str:
    """``functions.text.tidy`` of a Python string."""
    s = _RUNS_CS.sub(" ", s) if case_sensitive else _RUNS.sub(" ", s.lower())
    s = _ENDS.sub("", s)
    return _LAST_S.sub("'s", _SPLIT_S.sub("'s ", s, count=1))


class ContentFilter:
    """Which names may be entities."""

    def __init__(self, settings: Settings, shortest: int):
        self.least = min(T.MIN_LENGTH, shortest)
        self.words, self.phrases = frozenset(settings.stopwords), [p.lower() for p in settings.phrases]
        self.pattern = re.compile(re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", T.language_pattern(settings.lang)))
        self.punct = re.compile(f"{T.PUNCT}+")

    def __call__(self, name: str) -> bool:
        if not self.least <= len(name) <= T.MAX_LENGTH or len(name) == 1 and name.isascii() and name.isalpha() or name.isascii() and name.isdigit() or self.punct.fullmatch(name):
            return False
        low = name.strip().lower()
        return low not in self.words and not any(low in p for p in self.phrases) and bool(self.pattern.fullmatch(name))


def occurrences(page: str, seeds: Seeds) -> list[Occurrence]:
    """All non-overlapping occurrences of each seed that have text on both sides."""
    out = []
    for i, expression, turned in seeds.expressions:
        for m in expression.finditer(page):
            left, right = page[max(0, m.start() - CONTEXT) : m.start()], page[m.end() : m.end() + CONTEXT]
            if not left or not right:
                continue
            middle = None
            if m.re.groups:
                middle = m.group(1)
                if middle == " ":
                    continue
                middle = middle.strip() or middle
            out.append(Occurrence(i, left[::-1], right, middle, turned))
    return out


def _deepest(side: list[tuple[str, int]], enough) -> list[str]:
    """The longest common prefixes whose members satisfy ``enough`` (of their seeds); ``side`` is sorted text and seed."""
    out: list[str] = []
    todo = [(0, len(side))]
    while todo:
        a, b = todo.pop()
        shared = commonprefix((side[a][0], side[b - 1][0]))
        deeper, n, i = [], len(shared), a
        while i < b and len(side[i][0]) == n:
            i += 1
        while i < b:
            j, c = i, side[i][0][n]
            while j < b and side[j][0][n] == c:
                j += 1
            if (j - i < b - a) and enough({s for _, s in side[i:j]}):
                deeper.append((i, j))
            i = j
        if deeper:
            todo += deeper
        else:
            out.append(shared)
    return out


def _top(context: str, least: int) -> str | None:
    """The shortest prefix that counts as a context of its own; a single space doesn't."""
    if len(context) < least:
        return None
    top = context[:least]
    return top if top != " " else context[:2] if len(context) > 1 else None


def _maximal(prefixes: Iterable[str]) -> list[str]:
    """Those that no other one continues."""
    ordered = sorted(set(prefixes))
    return [p for p, q in zip(ordered, [*ordered[1:], None]) if q is None or not q.startswith(p)]


def _one_way(occ: list[Occurrence], first: str, second: str, enough, least: int) -> Iterator[tuple[str, str]]:
    """Pairs (context on the first side, context on the second), the first made as long as possible before the second."""
    groups = defaultdict(list)
    for o in occ:
        if (top := _top(getattr(o, second), least)) is not None and _top(getattr(o, first), least) is not None:
            groups[top, o.middle, o.reversed].append(o)
    found: list[str] = []
    for group in groups.values():
        if enough({o.seed for o in group}):
            tops = defaultdict(list)
            for o in group:
                tops[_top(getattr(o, first), least)].append((getattr(o, first), o.seed))
            for side in tops.values():
                if enough({s for _, s in side}):
                    found += _deepest(sorted(side), enough)
    for context in _maximal(found):
        by_middle = defaultdict(list)
        for o in occ:
            if getattr(o, first).startswith(context) and (top := _top(getattr(o, second), least)) is not None:
                by_middle[top, o.middle, o.reversed].append((getattr(o, second), o.seed))
        others: list[str] = []
        for side in by_middle.values():
            if enough({s for _, s in side}):
                others += _deepest(sorted(side), enough)
        for other in _maximal(others):
            yield context, other


def contexts(occ: list[Occurrence], settings: Settings) -> list[tuple[str, str | None, bool, str, frozenset[int]]]:
    """(left, middle, reversed, right, seeds) of all pairs of contexts that can't be made longer, once each."""
    least = settings.min_context
    present = {o.seed for o in occ}
    if len(present) < 2:
        return []
    weight = lambda seeds: sum(settings.weights.get(s, 1.0) for s in seeds)
    need, heavy = max(2, settings.bracket), 0.0
    if settings.bracket == 0:
        need = len(present)
    elif settings.bracket < 0:
        pairs = defaultdict(set)
        for o in occ:
            if (a := _top(o.left, least)) is not None and (b := _top(o.right, least)) is not None:
                pairs[a, b, o.middle, o.reversed].add(o.seed)
        need = max(2, max((len(s) for s in pairs.values()), default=0)) if settings.bracket == -1 or not settings.weights else 2
        heavy = max((weight(s) for s in pairs.values()), default=0.0) if settings.bracket == -2 and settings.weights else 0.0
    enough = lambda seeds: len(seeds) >= need and (not heavy or weight(seeds) >= heavy * (1 - 1e-12))
    pairs_of = dict.fromkeys(_one_way(occ, "left", "right", enough, least))
    pairs_of |= dict.fromkeys((b, a) for a, b in _one_way(occ, "right", "left", enough, least))
    out = []
    for left, right in pairs_of:
        by_middle = defaultdict(set)
        for o in occ:
            if o.left.startswith(left) and o.right.startswith(right):
                by_middle[o.middle, o.reversed].add(o.seed)
        (middle, turned), seeds = max(by_middle.items(), key=lambda x: (len(x[1]), x[0][0] or "", x[0][1]))
        if enough(seeds) and left != " " and right != " ":
            out.append((left[::-1], middle, turned, right, frozenset(seeds)))
    return sorted(out, key=lambda x: (x[0], x[1] or "", x[2], x[3]))


def _level(s: str, level: int, left: bool) -> bool:
    s = s.strip()
    if level == 1:
        return "<" in s or ">" in s
    if level == 2:
        return s.endswith(">") if left else s.startswith("<")
    if level == 3:
        return bool(re.search("<[^<>]+>", s))
    if level == 4:
        return bool(re.search(r"<[^<>]+>\Z", s) if left else re.match("<[^<>]+>", s))
    return level == 0


def strict_enough(left: str, middle: str | None, right: str, level: int) -> bool:
    a, b = divmod(level, 10)
    return _level(left, a, True) and _level(right, b, False) and (middle is None or _level(middle, b, False) and _level(middle, a, True))


def extract(page: str, left: str, right: str, least: int, good: ContentFilter, middle: str | None = None, turned: bool = False) -> list[tuple[str, str | None, str, str | None]]:
    """The contents (names, and as written) between each ``left`` and the first ``right`` after it.

    Of several lefts before one right only the nearest counts; a right may be the start of the next left.
    """
    out, bad = [], 0
    at, mid_at, right_at = page.find(left), 0, 0
    while at != -1:
        end = at + len(left)
        if middle is not None:
            if end > mid_at:
                mid_at = page.find(middle, end + least)
                if mid_at == -1:
                    break
            if mid_at + len(middle) > right_at:
                right_at = page.find(right, mid_at + len(middle) + least)
                if right_at == -1:
                    break
        elif end > right_at:
            right_at = page.find(right, end + least)
            if right_at == -1:
                break
        stop = right_at if middle is None else mid_at
        nearer = page.find(left, end)
        if nearer == -1 or nearer + len(left) > stop:
            written = tidy(page[end:stop], True)
            if middle is None:
                hit = (tidy(written), None, written, None)
                fine = good(hit[0])
            else:
                other = tidy(page[mid_at + len(middle) : right_at], True)
                a, b = (other, written) if turned else (written, other)
                hit = (tidy(a), tidy(b), a, b)
                fine = good(hit[0]) and good(hit[1]) and a not in b and b not in a
            if fine:
                out.append(hit)
            else:
                bad += 1
                if (bad + 1) / (len(out) + 1) > BAD_TO_GOOD:
                    break
        at = nearer
    return out


SCHEMA = "left string, middle string, reversed boolean, right string, n_seeds int, ctx_len int, contents array<struct<arg1:string,arg2:string,written1:string,written2:string,tf:int>>"
_CONTENT = pa.struct([("arg1", pa.string()), ("arg2", pa.string()), ("written1", pa.string()), ("written2", pa.string()), ("tf", pa.int32())])


def patterns_of(page: str, seeds: Seeds, settings: Settings, good: ContentFilter, verify: bool = True) -> Iterator[dict]:
    """The patterns of a page that extract the seeds they bracket, and something besides (or all, unverified)."""
    occ = occurrences(page, seeds)
    found = contexts(occ, settings)
    if settings.uniseed and len({o.seed for o in occ}) == 1:
        found = _of_one_seed(occ, settings)
    names = {n: i for i, n in reversed(list(enumerate(seeds.names)))}
    done: set[tuple] = set()
    for left, middle, turned, right, bracketed in found:
        if not strict_enough(left, middle, right, settings.html_level):
            continue
        contents = extract(page, left, right, good.least, good, middle, turned)
        counts: dict[tuple, int] = defaultdict(int)
        for c in contents:
            counts[c] += 1
        own = {(c[0], c[1]) for c in counts}
        if verify and (len(own & names.keys()) < len(bracketed) or not own - names.keys()):
            continue
        if settings.uniseed and (occurrence := (right[:1], left[-1:])) in done:
            continue
        elif settings.uniseed:
            done.add(occurrence)
        yield {"left": left, "middle": middle, "reversed": turned, "right": right, "n_seeds": len(bracketed), "ctx_len": len(left) + len(middle or "") + len(right), "contents": [dict(zip(("arg1", "arg2", "written1", "written2", "tf"), (*c, n))) for c, n in sorted(counts.items(), key=lambda x: tuple(map(str, x[0])))]}


def _of_one_seed(occ: list[Occurrence], settings: Settings) -> list[tuple]:
    """Candidates from a single seed: contexts of falling length; the longest that extracts anything is kept."""
    out = []
    for o in occ:
        for n in UNISEED_LENGTHS:
            left, right = o.left[:n][::-1], o.right[:n]
            if left != " " and right != " ":
                out.append((left, o.middle, o.reversed, right, frozenset([o.seed])))
    return out


def induce(pages: DataFrame, seeds: Iterable[str | tuple[str, str]], settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """Verified patterns of all pages: ``id_col, doc_len, left, middle, reversed, right, n_seeds, ctx_len, contents``.

    ``contents`` are the extracted names with how they were written and how often. Without ``verify`` all pairs of contexts
    come out, also those that extract too little. Pages without two seeds (or, with
    ``uniseed``, one) have none; null and empty pages neither. A page given twice counts twice.
    """
    known = Seeds(seeds)
    good = ContentFilter(settings, known.shortest)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("left", "middle", "reversed", "right", "n_seeds", "ctx_len")
        types = (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32())
        for batch in batches:
            rows, at, sizes = [], [], []
            for i, x in enumerate(batch.column(1)):
                page = x.as_py()
                for p in patterns_of(page, known, settings, good, verify):
                    rows.append(p)
                    at.append(i)
                    sizes.append(len(page))
            if rows:
                columns = [batch.column(0).take(pa.array(at)), pa.array(sizes, pa.int32()), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types)), pa.array([r["contents"] for r in rows], pa.list_(_CONTENT))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "doc_len", *names, "contents"])

    low = F.lower(F.col("text"))
    tokens = Counter(known.tokens())  # of seeds that share a token a page with it may hold all
    hits = sum((F.when(low.contains(t), n).otherwise(0) for t, n in sorted(tokens.items())), F.lit(0))
    pages = pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").where(hits >= (1 if settings.uniseed or tokens.total() < 2 else 2))
    return pages.mapInArrow(run, f"id {kind}, doc_len int, {SCHEMA}").withColumnRenamed("id", id_col)


def seed_occurrences(pages: DataFrame, seeds: Iterable[str | tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, arg1, arg2, left, middle, reversed, right`` of each occurrence of each seed."""
    known = Seeds(seeds)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, o) for i, x in enumerate(batch.column(1)) for o in occurrences(x.as_py(), known)]
            if found:
                own = [o for _, o in found]
                columns = [[known.rows[o.seed][0] for o in own], [known.rows[o.seed][1] for o in own], [o.left[::-1] for o in own], [o.middle for o in own], [o.reversed for o in own], [o.right for o in own]]
                types = [pa.string()] * 4 + [pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found])), *map(pa.array, columns, types)], ["id", "arg1", "arg2", "left", "middle", "reversed", "right"])

    low = F.lower(F.col("text"))
    any_of = F.lit(False)
    for t in sorted(set(known.tokens())):
        any_of = any_of | low.contains(t)
    pages = pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").where(any_of)
    return pages.mapInArrow(run, f"id {kind}, arg1 string, arg2 string, left string, middle string, reversed boolean, right string").withColumnRenamed("id", id_col)


def extractions(patterns: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per pattern and name: ``id_col, doc_len, left, middle, reversed, right, n_seeds, ctx_len, arg1, arg2, tf``."""
    keys = [id_col, "doc_len", "left", "middle", "reversed", "right", "n_seeds", "ctx_len"]
    per = F.explode("contents").alias("c")
    return patterns.select(*keys, per).groupBy(*keys, "c.arg1", "c.arg2").agg(F.sum("c.tf").alias("tf"))


def pattern_quality(patterns: DataFrame) -> DataFrame:
    """One row: the patterns, and the mean over them of seeds times the logarithm of the contexts' length."""
    return patterns.agg(F.count(F.lit(1)).alias("n_patterns"), (F.sum(F.col("n_seeds") * F.log("ctx_len")) / F.count(F.lit(1))).alias("quality"))


def written_forms(patterns: DataFrame, id_col: str = "doc_id", keep: int = 10) -> DataFrame:
    """``name, written, weight, rank``: how names were written, by votes of one per pattern and page; a form with a hyphen
    counts half, one that equals the name a tenth. The ``keep`` best of each name."""
    from pyspark.sql import Window as W

    c = F.explode("contents").alias("c")
    each = patterns.select(id_col, "left", "middle", "reversed", "right", c)
    two = F.explode(F.array(F.struct(F.col("c.arg1").alias("name"), F.col("c.written1").alias("written")), F.struct(F.col("c.arg2").alias("name"), F.col("c.written2").alias("written")))).alias("f")
    votes = each.select(id_col, "left", "middle", "reversed", "right", two).where("f.name IS NOT NULL").select(id_col, "left", "middle", "reversed", "right", "f.name", "f.written").distinct()
    weight = F.when(F.col("written") == F.col("name"), 0.1).when(F.col("written").contains("-"), 0.5).otherwise(1.0)
    total = votes.groupBy("name", "written").agg(F.sum(weight).alias("weight"))
    return total.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy(F.col("weight").desc(), "written"))).where(F.col("rank") <= keep)
