"""Set expansion: from a few entities and pages to a ranked list of more, once or in rounds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.operators import entities as E
from setweave.operators import patterns as P
from setweave.operators import ranking as R
from setweave.runtime import stash

Seed = str | tuple[str, str]


@dataclass(frozen=True)
class Expansion:
    """Parameters of an expansion. ``lang`` is that of contents; ``noisy`` seeds are ranked like any entity."""

    settings: P.Settings = P.Settings()
    feature: str = "WLW"
    noisy: bool = False


def facts_of(patterns: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rankers' facts of induced patterns: a pattern is known by its contexts, a pair as ``a::b``."""
    wrapper = F.concat_ws("[...]", "left", "middle", "right")
    each = P.extractions(patterns, id_col)
    return each.select(F.col(id_col).alias("doc"), F.regexp_replace(wrapper, r"\s", " ").alias("wrapper"), F.concat_ws("::", "arg1", "arg2").alias("entity"), "tf", "ctx_len", "doc_len")


def name_of(seed: Seed) -> str:
    a, b = (seed, None) if isinstance(seed, str) else seed
    return "::".join(x for x in P.canonical(a, b) if x is not None)


def score(weights: DataFrame, seeds: Sequence[Seed], noisy: bool) -> DataFrame:
    """``entity, weight, score, is_seed`` from weights."""
    is_seed = F.col("entity").isin([name_of(s) for s in seeds])
    return E.scored(weights, None if noisy else is_seed).withColumn("is_seed", is_seed)


def expand(pages: DataFrame, seeds: Sequence[Seed], how: Expansion = Expansion(), page_seeds: Sequence[Seed] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``entity, weight, score, is_seed`` of everything that the seeds' patterns extract.

    With ``page_seeds`` pages are chosen that hold any of them, and patterns are made with ``seeds``.
    """
    if page_seeds is not None:
        low = F.lower(F.col(text_col))
        any_of = F.lit(False)
        for t in sorted(set(P.Seeds(page_seeds).tokens())):
            any_of = any_of | low.contains(t)
        pages = pages.where(any_of)
    found = P.induce(pages, seeds, how.settings, id_col, text_col)
    weights = R.rank(facts_of(found, id_col), [name_of(s) for s in seeds], how.feature)
    return score(weights, seeds, how.noisy)


# --- rounds ---

#: Ways to choose the seeds of the next round.
POLICIES = ("FSS_SUPERVISED", "FSS_SEMI_SUPERVISED", "FSS_UNSUPERVISED", "FSS_UNSUPERVISED_V2", "ISS_SUPERVISED", "ISS_UNSUPERVISED", "CIS_SUPERVISED")
MAX_SEEDS = 4
MAX_COMBINATIONS = 128


def _order(seed: int, x: str) -> int:
    """A repeatable random-looking order."""
    h = 1469598103934665603 ^ seed
    for c in x.encode():
        h = (h ^ c) * 1099511628211 % (1 << 64)
    return h


def ranked_combinations(ranked: Sequence[tuple[str, float]], k: int, log: bool = False, most: int = MAX_COMBINATIONS) -> list[tuple[tuple[str, ...], float]]:
    """Combinations of ``k`` of the first n entities, by the sum of the logarithms of their weights; n is the largest for
    which there are at most ``most``."""
    n = k
    while n < len(ranked) and math.comb(n + 1, k) <= most:
        n += 1
    value = lambda w: w if log else math.log(w) if w > 0 else -math.inf
    rows = [(tuple(e for e, _ in c), sum(value(w) for _, w in c)) for c in combinations(ranked[:n], k)] if len(ranked) >= k else []
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def paired_combinations(true: Sequence[str], n_true: int, possible: Sequence[tuple[str, float]], n_possible: int, seed: int, history: set[frozenset[str]] = frozenset(), log: bool = False, shuffles: int = MAX_COMBINATIONS) -> list[tuple[str, ...]]:
    """Combinations of true seeds (of repeatable shuffles) with ranked ones of possible seeds, without overlaps and
    without those already used."""
    firsts = list(dict.fromkeys(tuple(sorted(sorted(true, key=lambda t: _order(seed * 1000 + s, t))[:n_true])) for s in range(shuffles))) if n_true <= len(true) else []
    out = []
    for mine in firsts:
        for theirs, _ in ranked_combinations(possible, n_possible, log) if n_possible else [((), 0.0)]:
            both = mine + theirs
            if len(set(both)) == len(both) and frozenset(both) not in history:
                out.append(both)
    return out


@dataclass
class SeedSelector:
    """Chooses seeds round by round; the same arguments always give the same choice."""

    policy: str
    true_seeds: Sequence[str]
    n_true: int = 2
    n_possible: int = 0
    seed: int = 0
    log: bool = False
    used: list[tuple[str, ...]] = field(default_factory=list)
    known: list[str] = field(default_factory=list)

    def select(self, ranked: Sequence[tuple[str, float]] = ()) -> tuple[str, ...] | None:
        """The seeds of the next round, given the last one's entities by rank; None if there are none left."""
        if self.policy not in POLICIES:
            raise ValueError(f"no policy {self.policy}")
        possible = [(e, w) for e, w in ranked if e not in set(self.true_seeds)]
        history = {frozenset(u) for u in self.used}
        first = not self.used
        picked: tuple[str, ...] | None
        if self.policy == "CIS_SUPERVISED":
            i = len(self.used)
            picked = tuple(self.true_seeds[i : i + self.n_true]) if i + self.n_true <= len(self.true_seeds) else None
        elif self.policy == "FSS_SUPERVISED" or first:
            found = paired_combinations(self.true_seeds, self.n_true, (), 0, self.seed, history)
            picked = found[0] if found else None
        elif self.policy == "FSS_SEMI_SUPERVISED":
            found = paired_combinations(self.true_seeds, self.n_true, possible, self.n_possible or 1, self.seed, history, self.log)
            picked = found[0] if found else None
        elif self.policy in ("FSS_UNSUPERVISED", "FSS_UNSUPERVISED_V2"):
            pool = list(ranked) if self.policy == "FSS_UNSUPERVISED" else possible
            found = [c for c, _ in ranked_combinations(pool, self.n_true + self.n_possible, self.log) if frozenset(c) not in history]
            picked = found[0] if found else None
        else:  # growing sets of seeds
            pool = list(self.true_seeds) if self.policy == "ISS_SUPERVISED" else [e for e, _ in ranked]
            fresh = [e for e in pool if e not in self.known]
            base = self.known if len(self.known) < MAX_SEEDS else self.known[-(MAX_SEEDS - 1) :]
            picked = tuple([*base, fresh[0]]) if fresh else None
        if picked is not None:
            self.used.append(picked)
            self.known += [p for p in picked if p not in self.known]
        return picked


def iterate(pages: DataFrame, selector: SeedSelector, rounds: int, how: Expansion = Expansion(), id_col: str = "doc_id", text_col: str = "text", each: Callable[[int, tuple, DataFrame], None] | None = None, reuse: bool = False) -> DataFrame:
    """Expansion in rounds: seeds are selected, expanded, and what was found feeds the next selection. With ``reuse`` the
    later rounds look at the pages only that the first one found patterns on.

    Facts of all rounds are kept (once each), so weights accumulate over the rounds as over pages. Between rounds only
    the first entities of the list come to the driver. Ends early if no seeds are left.
    """
    facts, ranked, result, chosen = None, [], None, []
    for i in range(rounds):
        seeds = selector.select(ranked)
        if not seeds:
            break
        chosen += [s for s in seeds if s not in chosen]
        new = facts_of(P.induce(pages, list(seeds), how.settings, id_col, text_col), id_col)
        facts = stash(new if facts is None else facts.unionByName(new).distinct(), "facts")
        if reuse and i == 0:
            pages = stash(pages.join(facts.select(F.col("doc").alias(id_col)).distinct(), id_col, "left_semi"), "pages")
        weights = R.rank(facts, [name_of(s) for s in chosen], how.feature)
        result = stash(score(weights, chosen, how.noisy), "round")
        ranked = [(r.entity, r.weight) for r in E.top(result, MAX_COMBINATIONS, by="score").select("entity", "weight").collect()]
        if each:
            each(i, seeds, result)
    if result is None:
        return pages.sparkSession.createDataFrame([], "entity string, weight double, score double, is_seed boolean")
    return result


class SetExpander:
    """An expander that keeps its state over several calls: pages once, seeds so far, facts, the last list."""

    def __init__(self, pages: DataFrame, how: Expansion = Expansion(), id_col: str = "doc_id", text_col: str = "text"):
        self.pages, self.how, self.id_col, self.text_col = pages, how, id_col, text_col
        self.past_seeds: list[Seed] = []
        self.last_seeds: list[Seed] = []
        self.facts: DataFrame | None = None
        self.patterns: DataFrame | None = None
        self.entities: DataFrame | None = None

    def configured(self, **changes) -> SetExpander:
        """The same expander with other parameters (``feature``, ``noisy``, or any of the settings)."""
        own = {k: v for k, v in changes.items() if k in ("feature", "noisy")}
        rest = {k: v for k, v in changes.items() if k not in own}
        self.how = replace(self.how, settings=replace(self.how.settings, **rest), **own)
        return self

    def expand(self, seeds: Sequence[Seed], page_seeds: Sequence[Seed] | None = None) -> DataFrame:
        self.last_seeds = list(seeds)
        self.past_seeds += [s for s in seeds if s not in self.past_seeds]
        pages = self.pages
        if page_seeds is not None:
            low = F.lower(F.col(self.text_col))
            pages = pages.where(F.greatest(*[low.contains(t).cast("int") for t in P.Seeds(page_seeds).tokens()], F.lit(0)) > 0)
        self.patterns = stash(P.induce(pages, seeds, self.how.settings, self.id_col, self.text_col), "patterns")
        new = facts_of(self.patterns, self.id_col)
        self.facts = stash(new if self.facts is None else self.facts.unionByName(new).distinct(), "facts")
        weights = R.rank(self.facts, [name_of(s) for s in self.past_seeds], self.how.feature)
        self.entities = score(weights, self.past_seeds, self.how.noisy)
        return self.entities

    def quality(self) -> float | None:
        """The quality of the last call's patterns."""
        return None if self.patterns is None else P.pattern_quality(self.patterns).first()["quality"]


def combination_table(items: DataFrame, k: int, order: str = "pos", value: str = "item") -> DataFrame:
    """All combinations of ``k`` of a small table's items in order, as columns ``item_1`` to ``item_k``."""
    out = items.select(F.col(order).alias("_p"), F.col(value).alias("item_1"))
    for i in range(2, k + 1):
        out = out.join(items.select(F.col(order).alias("_q"), F.col(value).alias(f"item_{i}")), F.col("_p") < F.col("_q")).withColumn("_p", F.col("_q")).drop("_q")
    return out.drop("_p")


def subsets(seeds: Iterable[Seed], k: int) -> list[tuple[Seed, ...]]:
    """The queries of ``k`` seeds each; 0 is one query of all."""
    seeds = list(seeds)
    return [tuple(seeds)] if k <= 0 or k >= len(seeds) else list(combinations(seeds, k))
