"""Evaluation texts that leaked into a corpus, found with suffix arrays of the corpus.

The corpus is read once, in shards of bounded size. A shard's tokens (words, or letters and digits for languages without
spaces) become one array, of which the suffixes are sorted; every suffix of every evaluation text is then looked up by
binary search, and the stretch of equal suffixes gives all places where it occurs, which are extended to the longest
match. Only suffixes that could begin a match are sorted: a token that occurs in no evaluation text ends any match, so
shards of a corpus that shares little with them need almost no sorting, and nothing is lost. Equal suffixes of many
evaluation texts are looked up once.

Nothing is shuffled but the matches. The evaluation texts are tokenized by tasks, in blocks of a bounded size; each block
is a broadcast of its own, and a task holds one of them at a time while it goes over them for a shard.
"""

from __future__ import annotations

import pickle
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
MIN_CHARS = 24
#: Languages whose items are compared by letters and digits.
BY_CHARACTER = ("ja", "zh-CN")
#: Bytes of the evaluation texts of one block.
BLOCK_BYTES = 32 * 1024 * 1024
#: Matches that are extended at once; more are taken one part after the other.
MATCHES = 2_000_000
#: Tokens of one shard; a longer document is a shard of its own.
SHARD_TOKENS = 2_000_000


@lru_cache(maxsize=1)
def _categories() -> tuple[str, np.ndarray]:
    """Ranges of all combining marks for a regular expression, and which code points are letters or digits."""
    marks, kept = [], np.zeros(sys.maxunicode + 1, bool)
    for o in range(sys.maxunicode + 1):
        cat = unicodedata.category(chr(o))[0]
        if cat == "M":
            if marks and marks[-1][1] == o - 1:
                marks[-1][1] = o
            else:
                marks.append([o, o])
        kept[o] = cat in "LN"
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in marks), kept


@lru_cache(maxsize=1)
def _word() -> re.Pattern:
    return re.compile(f"[\\w{_categories()[0]}]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits (with their combining marks), lower-cased."""
    return _word().findall(text.lower().replace("_", " "))


def letters(text: str) -> np.ndarray:
    """Code points of the letters and digits of ``text``, lower-cased."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return points[_categories()[1][points]].astype(np.int32)


class Probe:
    """The evaluation texts of one block and kind, as numbered tokens, ready to be looked up in shards."""

    def __init__(self, items: Sequence[tuple[int, str]], least: int, by_character: bool):
        self.least, self.by_character = least, by_character
        self.vocabulary: dict = {}
        arrays, self.items, self.begins, at = [], [], [], 0
        for item, text in items:
            ids = [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in (letters(text).tolist() if by_character else words(text))]
            if len(ids) >= least:
                arrays += [np.array(ids, np.int32), np.zeros(1, np.int32)]
                self.items.append(item)
                self.begins.append(at)
                at += len(ids) + 1
        self.tokens = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
        self.items, self.begins = np.array(self.items, np.int64), np.array(self.begins, np.int64)
        # suffixes in order; those that begin with the same tokens are one class, of which the first is looked up
        places, rank = _ranked(self.tokens, least)
        self.order = places[np.argsort(rank[places], kind="stable")].astype(np.int32)
        self.classes = np.flatnonzero(np.diff(rank[self.order], prepend=-1)).astype(np.int32)

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The number of the item that each place belongs to."""
        return np.searchsorted(self.begins, places, side="right") - 1


class Shard:
    """Tokens of some documents, every document followed by a break (0). Words are numbered within the shard; characters
    are their code points."""

    def __init__(self, by_character: bool):
        self.by_character = by_character
        self.vocabulary: dict = defaultdict(count(1).__next__)
        self.arrays: list[np.ndarray] = []
        self.docs: list[int] = []
        self.size = 0

    def add(self, doc: int, tokens) -> None:
        if not self.by_character:
            tokens = np.fromiter(map(self.vocabulary.__getitem__, tokens), np.int32, len(tokens))
        self.arrays += [tokens, np.zeros(1, np.int32)]
        self.docs.append(doc)
        self.size += len(tokens) + 1

    def joined(self) -> np.ndarray:
        return np.concatenate(self.arrays)

    def as_in(self, probe: Probe, tokens: np.ndarray) -> np.ndarray:
        """The tokens by the numbers of the probe; 0 for those that occur in no evaluation text of it."""
        if self.by_character:
            table = np.zeros(sys.maxunicode + 1, np.int32)
            table[list(probe.vocabulary)] = list(probe.vocabulary.values())
        else:
            known = probe.vocabulary.get
            table = np.array([0, *[known(t, 0) for t in self.vocabulary]], np.int32)
        return table[tokens]

    def starts(self) -> np.ndarray:
        return np.cumsum([0] + [len(a) + 1 for a in self.arrays[::2]])


def _room(tokens: np.ndarray) -> np.ndarray:
    """For each place the number of tokens up to the next break (token 0)."""
    at = np.arange(len(tokens))
    breaks = np.where(tokens == 0, at, len(tokens))
    return np.minimum.accumulate(breaks[::-1])[::-1] - at if len(tokens) else at


def _ranked(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes with ``depth`` tokens before a break, and the rank of each place by these tokens.

    Ranks of prefixes of doubled length are merged until they cover the depth.
    """
    room = _room(tokens)
    places = np.flatnonzero(room >= depth)
    rank, length = tokens.astype(np.int64), 1
    while length < depth and len(places):
        step = min(length, depth - length)  # the second half may overlap the first
        valid = np.flatnonzero(room >= length + step)
        code = rank[valid] * (rank.max() + 1) + rank[valid + step]
        rank = np.zeros(len(tokens), np.int64)
        rank[valid] = np.unique(code, return_inverse=True)[1] + 1
        length += step
    return places, rank


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes with ``depth`` tokens before a break, sorted by these tokens, then by place."""
    places, rank = _ranked(tokens, depth)
    return places[np.argsort(rank[places], kind="stable")]


def _search(tokens: np.ndarray, sa: np.ndarray, probe: np.ndarray, starts: np.ndarray, depth: int, right: bool) -> np.ndarray:
    """Binary search of the suffixes of ``probe`` at ``starts`` among those of ``tokens`` in the order of ``sa``."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(sa), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        there, own = sa[mid], starts[open_]
        order = np.zeros(len(open_), np.int8)  # sign of (suffix in the shard - suffix of the item)
        left = np.arange(len(open_))
        for k in range(depth):
            d = np.sign(tokens[there[left] + k].astype(np.int64) - probe[own[left] + k])
            order[left] = d
            left = left[d == 0]
            if not len(left):
                break
        goes_right = order <= 0 if right else order < 0
        low[open_[goes_right]] = mid[goes_right] + 1
        high[open_[~goes_right]] = mid[~goes_right]


def matches(probe: Probe, tokens: np.ndarray, at_once: int = MATCHES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All longest matches of at least the probe's length, in parts: (place in the items, place in the shard, tokens)."""
    sa = suffix_array(tokens, probe.least)
    if not len(sa) or not len(probe.order):
        return
    order = probe.order.astype(np.int64)
    heads = order[probe.classes]
    first = _search(tokens, sa, probe.tokens, heads, probe.least, False)
    last = _search(tokens, sa, probe.tokens, heads, probe.least, True)
    # every suffix of a class that was found, with the stretch of the shard's suffixes
    sizes = np.diff(np.append(probe.classes, len(order)))
    first, count, own = np.repeat(first, sizes), np.repeat(last - first, sizes), order
    hit = np.flatnonzero(count > 0)
    first, count, own = first[hit], count[hit], own[hit]
    part = (np.cumsum(count) - count) // at_once
    for cut in np.split(np.arange(len(own)), np.flatnonzero(np.diff(part)) + 1) if len(own) else ():
        yield _extended(probe, tokens, sa, own[cut], first[cut], count[cut])


def _extended(probe: Probe, tokens: np.ndarray, sa: np.ndarray, own: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    there = sa[np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    own = np.repeat(own, count)
    # of matches that continue one another only the longest is kept: the one that can't begin a token earlier
    begins = (own == 0) | (there == 0) | (probe.tokens[own - 1] != tokens[there - 1]) | (tokens[there - 1] == 0)
    own, there = own[begins], there[begins]
    length = np.full(len(own), probe.least, np.int64)
    grow = np.arange(len(own))
    while len(grow):
        a, b = own[grow] + length[grow], there[grow] + length[grow]
        inside = (a < len(probe.tokens)) & (b < len(tokens))
        grow, a, b = grow[inside], a[inside], b[inside]
        grow = grow[(probe.tokens[a] == tokens[b]) & (tokens[b] != 0)]
        length[grow] += 1
    return own, there, length


def _found(probe: Probe, shard: Shard, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each item and document of a shard that match: the longest match, and how many there are."""
    starts, docs = shard.starts(), np.array(shard.docs, np.int64)
    for own, there, length in matches(probe, shard.as_in(probe, tokens)):
        if not len(own):
            continue
        item, doc = probe.owner(own), np.searchsorted(starts, there, side="right") - 1
        own, there = own - probe.begins[item], there - starts[doc]
        order = np.lexsort((there, own, -length, doc, item))
        item, doc, own, there, length = (x[order] for x in (item, doc, own, there, length))
        head = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]))))
        n = np.diff(np.append(head, len(item)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(probe.items[item[head]]), pa.array(docs[doc[head]]), pa.array(length[head].astype(np.int32)), pa.array(n), pa.array(own[head].astype(np.int32)), pa.array(there[head].astype(np.int32))],
            ["item_id", "doc_id", "length", "places", "item_place", "doc_place"],
        )


def _look_up(blocks: list, kinds: Sequence[tuple[bool, int]], shard_tokens: int):
    """``blocks``: a broadcast of pickled probes each. ``kinds``: by character or not, and the least tokens of a match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(shard: Shard) -> Iterator[pa.RecordBatch]:
            tokens = shard.joined()
            for block in blocks:
                for probe in _probes(block, len(blocks) == 1):
                    if probe.by_character == shard.by_character:
                        yield from _found(probe, shard, tokens)

        held = {by: Shard(by) for by, _ in kinds}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, x in enumerate(batch.column(1)):
                text = x.as_py()
                for by, least in kinds:
                    tokens = letters(text) if by else words(text)
                    if len(tokens) < least:
                        continue
                    if held[by].size and held[by].size + len(tokens) > shard_tokens:
                        yield from close(held[by])
                        held[by] = Shard(by)
                    held[by].add(ids[i], tokens)
        for shard in held.values():
            if shard.size:
                yield from close(shard)

    return run


_kept: dict = {}


def _probes(block, keep: bool) -> list[Probe]:
    """The probes of a block; those of the only one are kept for the next shard."""
    if block.id not in _kept:
        _kept.clear()
        _kept[block.id] = pickle.loads(block.blob.value)
        if hasattr(block.blob, "_value"):
            del block.blob._value
    return _kept[block.id]


class _Block:
    def __init__(self, blob):
        self.blob, self.id = blob, blob._jbroadcast.id()

    def __getstate__(self):
        return {"blob": self.blob, "id": self.id}


def _build(kinds: Sequence[tuple[bool, int]]):
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["by_character", "item_id", "text"]).to_pylist()
        probes = [Probe([(r["item_id"], r["text"]) for r in rows if r["by_character"] == by], least, by) for by, least in kinds]
        probes = [p for p in probes if len(p.order)]
        return pa.table({"has": [sorted(p.by_character for p in probes)], "blob": [pickle.dumps(probes)]})

    return run


def leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, by_character: Sequence[str] = BY_CHARACTER, block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``item_id, doc_id, length, n_places, item_place, doc_place`` of every document that repeats a passage of an item.

    ``length`` is that of the longest verbatim match, in words (letters and digits for items in ``by_character``
    languages), at token ``item_place`` of the item and ``doc_place`` of the document. Case, punctuation, white space and
    line breaks are ignored. Null and empty texts, and items shorter than the limit, match nothing.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("lang").alias("lang"), F.col("text").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    spark, schema = docs.sparkSession, "item_id bigint, doc_id bigint, length int, places bigint, item_place int, doc_place int"
    kinds = [(False, min_words), (True, min_chars)]
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    by = F.coalesce(F.col("lang").isin(list(by_character)), F.lit(False))
    items = items.select(by.alias("by_character"), "item_id", "text").distinct().withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    built = items.groupBy("block").applyInArrow(_build(kinds), "has array<boolean>, blob binary")
    blocks, used = [], set()
    for row in built.toLocalIterator():  # one block at a time is on the driver
        if row.has:
            blocks.append(_Block(spark.sparkContext.broadcast(bytes(row.blob))))
            used |= set(row.has)
    if blocks:
        found = docs.mapInArrow(_look_up(blocks, [k for k in kinds if k[0] in used], shard_tokens), schema)
    else:
        found = spark.createDataFrame([], schema)
    longest = F.max(F.struct(F.col("length"), (-F.col("item_place")).alias("i"), (-F.col("doc_place")).alias("d"))).alias("m")
    best = found.groupBy("item_id", "doc_id").agg(longest, F.sum("places").alias("n_places"))
    return best.select("item_id", "doc_id", F.col("m.length").alias("length"), "n_places", (-F.col("m.i")).alias("item_place"), (-F.col("m.d")).alias("doc_place"))


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that repeat a passage of any item."""
    return docs.join(leaks(docs, items, **options).select("doc_id").distinct(), "doc_id", "left_anti")
