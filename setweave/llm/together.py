"""Items that appear together: co-occurrence by stripes, with the log-likelihood ratio of each pair.

Every group (a column, a basket, a session) contributes to each of its items a stripe, an associative array of the
neighbours that it was seen with. Stripes of one item are added up, first within a task, then over all tasks.

* A stripe is one row: the item, its neighbours in order, and how often each was met. Rows are shuffled by item and
  merged as they arrive in order, so a task holds one item's stripe at a time. A hot item's stripe is split into pieces
  by a hash of the neighbour.
* An item that is in so many groups that no pair of it can reach ``min_lift`` is left out beforehand; there are at most
  as many of them as a group has items on average times ``min_lift``, and they are broadcast only if counted to be few.
* In a wide group only those items meet that show it. All wide groups are put into one order, and each item hides its
  last ``min_shared - 1``: two items that share enough groups then both show the first wide group they share, or meet in
  a group that isn't wide. Those that meet are compared block by block; what the candidates share among hidden groups is
  looked up afterwards, so the counts are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setweave.runtime import if_small, stash

#: Members from which a group counts as wide.
WIDE = 1024
#: Entries that a task adds up before it sends stripes, and that the receiver of stripes is planned for.
BUFFER = 1_000_000
PER_TASK = 500_000
#: Most items whose stripes are split; the bound of what is sent to all tasks for that.
HOT_ITEMS = 1_000_000
SEEDS = range(8)

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: ``more`` is the most that item and neighbour can share among hidden groups; there is none without wide groups.
STRIPE = "item bigint, piece int, neighbours array<bigint>, counts array<int>, more array<int>"


def item_key(c: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), c)


def group_key(c: Column) -> list[Column]:
    return [F.xxhash64(F.lit(101), c).alias("g1"), F.xxhash64(c, F.lit(211)).alias("g2")]


def _sum_up(a: np.ndarray, b: np.ndarray, n: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of one (a, b) added up, in the order of a, then b; ``more`` is the same for all of a pair."""
    if not len(a):
        return a, b, n, more
    order = np.lexsort((b, a))
    a, b, n, more = a[order], b[order], n[order], more[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[first], b[first], np.add.reduceat(n, first), more[first]


def _piece(b: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = b.astype(np.uint64) * _MIX
        x = (x ^ (x >> np.uint64(29))) * _MIX
    return ((x >> np.uint64(33)) % pieces.astype(np.uint64)).astype(np.int32)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, one after the other, and where each list begins and ends among them."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


class _Known:
    """What is special of some items of a batch: the pieces of their stripes, and their number of wide groups."""

    def __init__(self, column: pa.Array):
        flat = column.flatten()
        ids = flat.field("i").to_numpy()
        self.ids, first = np.unique(ids, return_index=True)
        self.pieces, self.wide = flat.field("pieces").to_numpy()[first], flat.field("wide").to_numpy()[first]

    def of(self, values: np.ndarray, items: np.ndarray, default: int) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(items), default, np.int32)
        at = np.minimum(np.searchsorted(self.ids, items), len(self.ids) - 1)
        return np.where(self.ids[at] == items, values[at], default).astype(np.int32)


class _Stripes:
    """Adds up what a task meets, and gives it out as stripes."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray, known: _Known) -> None:
        more = np.minimum(known.of(known.wide, a, 0), known.of(known.wide, b, 0))
        self.parts.append((a, b, _piece(b, known.of(known.pieces, a, 1)), more))
        self.held += len(a)

    def out(self) -> pa.RecordBatch:
        a, b, piece, more = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        order = np.lexsort((b, piece, a))
        a, b, piece, more = a[order], b[order], piece[order], more[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        n = np.diff(np.append(first, len(a))).astype(np.int32)
        a, b, piece, more = a[first], b[first], piece[first], more[first]
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (piece[1:] != piece[:-1]))))
        offsets = np.append(starts, len(a))
        extra = _lists(more, offsets) if more.any() else pa.nulls(len(starts), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(piece[starts]), _lists(b, offsets), _lists(n, offsets), extra], ["item", "piece", "neighbours", "counts", "more"])


def _self_pairs(flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (a, b) with a <= b within each list, an item with itself included; lists of one length at a time."""
    sizes = np.diff(offsets)
    for k in np.unique(sizes):
        if k == 0:
            continue
        i, j = np.triu_indices(k)
        heads = offsets[:-1][sizes == k]
        step = max(1, BUFFER // len(i))
        for s in range(0, len(heads), step):
            members = np.sort(flat[heads[s : s + step, None] + np.arange(k)], axis=1)
            yield members[:, i].ravel(), members[:, j].ravel()


def _stripes_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (items of a group, what is special of them): the stripes of the items."""
    stripes = _Stripes()
    for batch in batches:
        known = _Known(batch.column(1))
        for a, b in _self_pairs(*_flat(batch.column(0))):
            stripes.add(a, b, known)
            if stripes.held >= BUFFER:
                yield stripes.out()
    if stripes.held:
        yield stripes.out()


def _stripes_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (block, another or the same block of a wide group, what is special of their items): the stripes."""
    stripes = _Stripes()
    for batch in batches:
        known = _Known(batch.column(3))
        (left, l_at), (right, r_at) = _flat(batch.column(0)), _flat(batch.column(1))
        for k, same in enumerate(batch.column(2).to_pylist()):
            u, v = left[l_at[k] : l_at[k + 1]], right[r_at[k] : r_at[k + 1]]
            step = max(1, BUFFER // max(1, len(v)))
            for s in range(0, len(u), step):
                x, y = np.repeat(u[s : s + step], len(v)), np.tile(v, len(u[s : s + step]))
                keep = x < y if same else x != y
                x, y = x[keep], y[keep]
                if len(x):
                    stripes.add(np.minimum(x, y), np.maximum(x, y), known)
                if stripes.held >= BUFFER:
                    yield stripes.out()
    if stripes.held:
        yield stripes.out()


def _merge(min_n: int):
    """Adds up stripes that come in the order of (item, piece), and gives out the pairs that may share ``min_n`` groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal parts, held
            a, b, n, more = _sum_up(*(np.concatenate(x) for x in zip(*parts)))
            cut = len(a) if last else np.searchsorted(a, a[-1])  # the last item's stripe may go on
            parts, held = [(a[cut:], b[cut:], n[cut:], more[cut:])], len(a) - cut
            a, b, n, more = a[:cut], b[:cut], n[:cut], more[:cut]
            keep = (a == b) | (n + more >= min_n)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, n, more)], ["a", "b", "n", "more"])

        for batch in batches:
            b, offsets = _flat(batch.column(2))
            a = np.repeat(batch.column(0).to_numpy(), np.diff(offsets))
            n = _flat(batch.column(3))[0].astype(np.int64)
            more, m_at = batch.column(4), np.zeros(len(b), np.int64)
            if more.null_count < len(more):
                filled = np.repeat(more.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets))
                m_at[filled] = more.drop_null().flatten().to_numpy()
            parts.append((a, b, n, m_at))
            held += len(a)
            if held >= BUFFER:
                yield flush(False)
        if parts:
            yield flush(True)

    return run


def log_likelihood_ratio(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Dunning's ratio for the two-by-two table of two items over ``n`` groups."""
    term = lambda k, r, c: F.when(k > 0, k * F.log(k * n / (r * c))).otherwise(0.0)
    return 2 * (term(n_ab, n_a, n_b) + term(n_a - n_ab, n_a, n - n_b) + term(n_b - n_ab, n - n_a, n_b) + term(n - n_a - n_b + n_ab, n - n_a, n - n_b))


def _wide_groups(cells: DataFrame, widths: DataFrame, wide: int, min_shared: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells outside wide groups, cells (i, g1, g2, w, hidden) of wide groups, and (i, wide) how many an item is in."""
    groups = stash(widths.where(F.col("w") > wide), "wide")
    within = cells.join(if_small(groups), ["g1", "g2"]).distinct()
    last = F.row_number().over(W.partitionBy("i").orderBy(F.col("w").desc(), "g1", "g2"))
    within = stash(within.withColumn("hidden", last < min_shared).select("i", "g1", "g2", "hidden"), "members")
    return cells.join(if_small(groups.select("g1", "g2")), ["g1", "g2"], "left_anti"), within, stash(within.groupBy("i").agg(F.count(F.lit(1)).cast("int").alias("wide")), "within")


def _blocks_that_meet(within: DataFrame, special: DataFrame, wide: int) -> DataFrame:
    """``left, right, same, special``: of each wide group every two blocks of the items that show it, none wider than
    about ``wide``."""
    shows = within.where("NOT hidden").select("i", "g1", "g2")
    shows = shows.join(shows.groupBy("g1", "g2").agg(F.ceil(F.count(F.lit(1)) / wide).alias("k")), ["g1", "g2"]).join(special, "i")
    block = shows.groupBy("g1", "g2", "k", F.pmod(F.xxhash64("i"), "k").alias("block")).agg(F.collect_list("i").alias("items"), F.collect_list(F.expr(SPECIAL)).alias("special"))
    # every block is sent to where it meets the blocks of no lower number
    left = block.withColumn("other", F.explode(F.sequence("block", F.col("k") - 1))).select("g1", "g2", "other", "block", F.col("items").alias("left"), F.col("special").alias("of_left"))
    right = block.select("g1", "g2", F.col("block").alias("other"), F.col("items").alias("right"), F.col("special").alias("of_right"))
    return left.join(right, ["g1", "g2", "other"]).select("left", "right", (F.col("block") == F.col("other")).alias("same"), F.concat("of_left", "of_right").alias("special"))


#: What tasks have to know of an item that is hot or in wide groups.
SPECIALS = "array<struct<i: bigint, pieces: int, wide: int>>"
SPECIAL = "struct(i, coalesce(pieces, 1) AS pieces, coalesce(wide, 0) AS wide)"


def _add_hidden(pairs: DataFrame, within: DataFrame, min_shared: int) -> DataFrame:
    """``a, b, n`` with what the two share among wide groups that either hides: its ≤ min_shared - 1 hidden ones are
    looked up among all of the other's, the other's hidden ones among those that it shows."""
    asked = pairs.where("more > 0").select("a", "b")
    hidden = lambda own, other: asked.join(within.where("hidden").select(F.col("i").alias(own), "g1", "g2"), own).select("a", "b", F.col(other).alias("i"), "g1", "g2")
    first = hidden("a", "b").join(within.select("i", "g1", "g2"), ["i", "g1", "g2"])
    second = hidden("b", "a").join(within.where("NOT hidden").select("i", "g1", "g2"), ["i", "g1", "g2"])
    found = first.unionByName(second).groupBy("a", "b").agg(F.count(F.lit(1)).alias("also"))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", (F.col("n") + F.coalesce("also", F.lit(0))).alias("n")).where(F.col("n") >= min_shared)


def co_occurrence(cells: DataFrame, item: str = "row_key", group: str = "column_key", min_shared: int = 5, min_lift: float = 10.0, min_llr: float = 0.0, wide: int = WIDE, per_task: int = PER_TASK) -> DataFrame:
    """``item_a, item_b, n_ab, n_a, n_b, n, lift, llr`` of all pairs (a < b by code point) that share at least
    ``min_shared`` groups, of which ``n_ab * n >= min_lift * n_a * n_b``, with ``llr >= min_llr``.

    Cells without an item or a group don't count, repeated cells count once, other columns are ignored. No pair, as of
    an empty table, gives no row.
    """
    cells = cells.select(F.col(item).alias("item"), F.col(group).alias("grp")).where("item IS NOT NULL AND grp IS NOT NULL")
    # items get 64-bit numbers; should two items share one, the next seed is tried
    for seed in SEEDS:
        numbered = cells.select(item_key(F.col("item"), seed).alias("i"), "item")
        items = stash(numbered.groupBy("i").agg(F.min("item").alias("item"), F.max("item").alias("last"), F.count(F.lit(1)).alias("cells")), "items")
        if items.where("item <> last").isEmpty():
            break
    else:
        raise RuntimeError("items can't be told apart by any seed")
    cells = cells.select(item_key(F.col("item"), seed).alias("i"), *group_key(F.col("grp")))
    widths = stash(cells.groupBy("g1", "g2").agg(F.count(F.lit(1)).cast("bigint").alias("w")), "groups")
    narrow = F.when(F.col("w") <= wide, F.col("w").cast("double")).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    figures = widths.agg(F.count(F.lit(1)).alias("n"), zero(F.sum(narrow * (narrow + 1) / 2)).alias("entries"), zero(F.sum("w")).alias("cells"), F.coalesce(F.max("w"), F.lit(0)).alias("widest")).first()
    n, entries = figures["n"], figures["entries"]

    # items in more than n / min_lift groups: cells bound them from above, so few need their groups counted
    suspects = items.where(F.col("cells") > n / min_lift).select("i")
    heavy = stash(cells.join(if_small(suspects), "i", "left_semi").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") * min_lift > n).select("i"), "heavy")
    cells = cells.join(if_small(heavy), "i", "left_anti")

    # stripes of items with many cells are split
    per_cell = max(1.0, entries / max(1, figures["cells"]))
    hot = items.where(F.col("cells") > max(per_task / per_cell, figures["cells"] / HOT_ITEMS)).join(if_small(heavy), "i", "left_anti")
    special = stash(hot.select("i", F.ceil(F.col("cells") * per_cell / per_task).cast("int").alias("pieces")), "hot").withColumn("wide", F.lit(0))
    within = None
    if figures["widest"] > wide:
        cells, within, counts = _wide_groups(cells, widths, wide, min_shared)
        special = stash(special.drop("wide").join(counts, "i", "full"), "special")
    if special.isEmpty():
        told = F.array().cast(SPECIALS)
    else:
        cells, told = cells.join(if_small(special), "i", "left"), F.collect_set(F.when(F.col("pieces").isNotNull() | F.col("wide").isNotNull(), F.expr(SPECIAL)))
    groups = cells.groupBy("g1", "g2").agg(F.collect_set("i").alias("items"), told.alias("special"))
    stripes = groups.select("items", "special").mapInArrow(_stripes_of_groups, STRIPE)
    if within is not None:
        met = stash(_blocks_that_meet(within, special, wide).mapInArrow(_stripes_of_blocks, STRIPE), "met")
        entries += met.agg(zero(F.sum(F.size("neighbours").cast("double")))).first()[0]
        stripes = stripes.unionByName(met)
    arriving = stripes.repartition(max(1, math.ceil(entries / per_task)), "item", "piece").sortWithinPartitions("item", "piece")
    merged = stash(arriving.mapInArrow(_merge(min_shared), "a bigint, b bigint, n bigint, more bigint"), "pairs")
    sizes = merged.where("a = b").select(F.col("a").alias("i"), F.col("n").alias("k"))
    pairs = merged.where("a <> b")
    if within is not None:
        sizes = sizes.unionByName(counts.select("i", F.col("wide").cast("bigint").alias("k"))).groupBy("i").agg(F.sum("k").alias("k"))
        pairs = _add_hidden(pairs, within, min_shared)
    side = lambda c: sizes.select(F.col("i").alias(c), F.col("k").alias(f"n_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("n") * n >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    named = lambda c: items.select(F.col("i").alias(c), F.col("item").alias(f"item_{c}"))
    pairs = pairs.join(named("a"), "a").join(named("b"), "b")
    turned = F.col("item_a") > F.col("item_b")
    n_all = F.lit(n).cast("double")
    pairs = pairs.select(
        F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"), F.col("n").alias("n_ab"),
        F.when(turned, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(turned, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"), F.lit(n).cast("bigint").alias("n"),
    )
    lift = F.col("n_ab") * n_all / (F.col("n_a") * F.col("n_b"))
    return pairs.withColumn("lift", lift).withColumn("llr", log_likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), n_all)).where(F.col("llr") >= min_llr)
