"""Expansion in two languages in turn: what one finds in the other's pages chooses the next seeds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.operators import entities as E
from setweave.operators import expansion as X
from setweave.operators import proximity as N
from setweave.runtime import stash


@dataclass
class Side:
    """One language: its name, its pages' expander, and who chooses its seeds."""

    lang: str
    expander: X.SetExpander
    selector: X.SeedSelector


@dataclass(frozen=True)
class Round:
    """What a round did: its language, its seeds, and the list after it (entity, weight, score, is_seed)."""

    lang: str
    seeds: tuple[str, ...]
    entities: DataFrame


def alternate(source: Side, target: Side, rounds: int, translate: Callable[[DataFrame, str], DataFrame] | None = None, similarity: float = N.SIMILAR) -> list[Round]:
    """Rounds of expansion, the even ones in the source language, the odd ones in the target language.

    From the third round on seeds are chosen among the language's own last entities, if ``translate`` is given only among
    those of which a translation is (nearly) among the other language's last entities; if none is, among all.
    ``translate(entities, lang)`` takes (entity, weight) in the language ``lang`` and gives (source, entity, score). Ends
    early if no seeds are left.
    """
    done: list[Round] = []
    for i in range(rounds):
        side = (source, target)[i % 2]
        ranked: Sequence[tuple[str, float]] = ()
        if i >= 2:
            possible = E.top(done[i - 2].entities, X.MAX_COMBINATIONS, by="score").select("entity", "weight")
            if translate is not None:
                known = stash(N.cross_verify(translate(possible, side.lang), done[i - 1].entities.select("entity", "weight"), similarity), "verified")
                verified = possible.join(known.select(F.col("source").alias("entity")).distinct(), "entity", "left_semi")
                possible = possible if known.isEmpty() else verified
            ranked = [(r.entity, r.weight) for r in E.top(possible, X.MAX_COMBINATIONS).collect()]
        seeds = side.selector.select(ranked)
        if not seeds:
            break
        done.append(Round(side.lang, tuple(seeds), stash(side.expander.expand(list(seeds)), "round")))
    return done
