"""From a category's name to its members: list phrases, noisy instances, expansion, bootstrapping."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.operators import entities as E
from setweave.operators import expansion as X
from setweave.operators import patterns as P
from setweave.operators import proximity as N
from setweave.operators import ranking as R
from setweave.runtime import stash
from setweave.sources import sinks

# Phrases that introduce members of a class (at <1>), and words of pages that list them, by language.
PHRASES = {
    "en": ("<1> such as", "<1> i.e.", "<1> e.g.", "<1> including", "<1> like", "and other <1>", "or other <1>", "such <1> as"),
    "ja": ("<1> 例えば", "<1> たとえば", "<1>は 例えば", "<1>は たとえば", "<1>と言えば", "<1>といえば", "等の<1>", "などの<1>", "とかの<1>"),
    "ko": ("<1>로는", "<1>으로", "<1> 예를 들면", "<1> 예를 들어", "등과 같은 <1>"),
    "zh-CN": ("<1> 例如", "<1> 比如", "<1> 包括", "<1> 包含", "<1> 譬如", "等<1>"),
    "zh-TW": ("<1> 例如", "<1> 比如", "<1> 包括", "<1> 包含", "<1> 譬如", "等<1>"),
}
LIST_WORDS = {"en": ("list", "names", "top", "best", "hot", "popular", "famous", "common"), "ja": ("一覧", "リスト", "有名", "普及"), "ko": ("목록", "리스트", "최고", "인기"), "zh-CN": ("列表", "名单", "清单", "一览", "有名", "着名", "热门"), "zh-TW": ("列表", "名單", "清單", "一覽", "有名", "著名", "熱門")}
MIN_SNIPPETS = 2
#: Instances below which the words of the category are asked for, and patterns above which a result is surer.
MIN_ENTITIES, MIN_PATTERNS = 2, 3
SHRINK_POWER = 3.0
TOP_SEEDS = 20
MIN_SEED_SCORE = 0.5
KEEP_RATIO = 0.01


def list_queries(category: str, lang: str = "en") -> list[tuple[str, bool]]:
    """(phrase, whether the class comes first) of each list phrase with the category in it."""
    return [(p.replace("<1>", category), p.startswith("<1>") or p.startswith("such")) for p in PHRASES[lang]]


def back_off(query: Column) -> Column:
    """A query of quoted phrases and other words as one: the quoted phrases, then what remains."""
    quoted = F.regexp_extract_all(query, F.lit('("[^"]+")'), F.lit(1))
    rest = F.trim(F.regexp_replace(F.regexp_replace(query, '"[^"]*"', " "), r"\s+", " "))
    return F.concat_ws(" ", F.array_join(F.when(F.size(quoted) > 0, quoted), " "), F.when(rest != "", rest))


def general_queries(category: str) -> list[tuple[str, bool]]:
    """(phrase, whether the class comes first) of the quoted phrases and single words of a category, from both sides."""
    quoted = [x.strip().lower() for x in re.findall('"(.+?)"', category)]
    words = re.sub('".+?"', " ", category).lower().split()
    return [(p, first) for p in dict.fromkeys([*quoted, *words]) if p for first in (True, False)]


def hint(category: str, lang: str = "en") -> str:
    """The words that pages with lists of the category may have."""
    return "(" + " OR ".join([*LIST_WORDS[lang], category]) + ")"


def instances(docs: DataFrame, phrases: Sequence[tuple[str, bool]], lang: str = "en", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``source, doc_id, excerpt, entity, dist`` of all chunks next to any of the phrases; nearer chunks count more."""
    texts = N.excerpts(docs, id_col, text_col)
    hit = F.array(*[F.struct(F.lit(p).alias("source"), N.chop(F.col("text"), p, first).alias("rest"), F.lit(first).alias("first")) for p, first in phrases])
    near = texts.select(id_col, "excerpt", F.explode(F.filter(hit, lambda h: h["rest"].isNotNull())).alias("h")).select(id_col, "excerpt", "h.source", "h.rest", "h.first")
    found = near.select("source", F.col(id_col).alias("doc_id"), "excerpt", "rest", "first", F.explode(N.chunks(F.col("rest"), lang)).alias("entity"))
    low = F.lower("rest")
    away = F.when(F.col("first"), F.position(F.col("entity"), low) - 1).otherwise(F.length("rest") - F.position(F.col("entity"), low) - F.length("entity") + 1)
    return found.select("source", "doc_id", "excerpt", "entity", (1 / (F.greatest(away, F.lit(0)) + 2)).alias("dist"))


def noisy_instances(docs: DataFrame, phrases: Sequence[tuple[str, bool]], lang: str = "en", min_snippets: int = MIN_SNIPPETS) -> DataFrame:
    """``entity, weight``: scored instances that at least ``min_snippets`` pages have."""
    found = stash(instances(docs, phrases, lang), "instances")
    counts = N.hierarchical_counts(found).where(F.col("snippets") >= min_snippets)
    return N.instance_scores(counts, N.totals(found)).withColumnRenamed("score", "weight")


@dataclass(frozen=True)
class Extracted:
    """Instances of a category (entity, weight), and how sure they are: 2, or 1 if they come from the back-off."""

    entities: DataFrame
    confidence: int


def extracted(docs: DataFrame, category: str, lang: str = "en", phrases: Sequence[tuple[str, bool]] | None = None, min_snippets: int = MIN_SNIPPETS) -> Extracted:
    """The instances that list phrases with the category introduce; if they are fewer than two, also what stands near the
    words of the category. Names of hiragana alone go in Japanese, and names that are a part of others give them their
    weight."""

    def tidied(found: DataFrame) -> DataFrame:
        if lang == "ja":
            found = found.where(~F.col("entity").rlike(r"^[\x{3040}-\x{309F}]+\z"))
        return stash(E.shrink(E.reduce_size(found.select("entity", "weight").where(F.col("entity") != category.lower())), SHRINK_POWER), "extracted")

    first = tidied(noisy_instances(docs, phrases or list_queries(category, lang), lang, min_snippets))
    if first.limit(MIN_ENTITIES).count() >= MIN_ENTITIES:
        return Extracted(first, 2)
    return Extracted(E.merge(first, tidied(noisy_instances(docs, general_queries(category), lang, min_snippets))), 1)


def expand_noisy(pages: DataFrame, initial: DataFrame, how: X.Expansion, rounds: int = 2) -> DataFrame:
    """The first instances as seeds of an expansion; what it finds of them replaces their weights, until that settles."""
    noisy = replace(how, noisy=True, settings=replace(how.settings, bracket=2))
    current = stash(initial, "initial")
    for _ in range(rounds):
        seeds = [r.entity for r in E.top(current, TOP_SEEDS).collect()]
        if len(seeds) < 2:
            break
        found = X.expand(pages, seeds, noisy).select("entity", F.col("score").alias("weight"))
        new = stash(E.interpolate(current, found, 0.0), "noisy")
        as_vector = lambda d: d.select(F.col("entity").alias("id"), F.col("weight").alias("value"))
        moved = R.distance(as_vector(new), as_vector(current)).first()["distance"]
        if new.isEmpty():
            break
        current = new
        if moved < 0.01:
            break
    return current


def hinted(pages: DataFrame, category: str, lang: str = "en", text_col: str = "text") -> DataFrame:
    """The pages that a hint asks for: those with a word of lists or the category."""
    low, any_of = F.lower(F.col(text_col)), F.lit(False)
    for word in (*LIST_WORDS.get(lang, ()), category.lower()):
        any_of = any_of | low.contains(word)
    return pages.where(any_of)


def bootstrap(pages: DataFrame, scored: DataFrame, how: X.Expansion, rounds: int = 2, category: str | None = None, lang: str = "en") -> DataFrame:
    """Rounds of expansion from the instances of good scores, four seeds at most at a time; with a category over the pages
    that its hint asks for."""
    pages = pages if category is None else hinted(pages, category, lang)
    good = E.top(scored.where(F.col("weight") >= MIN_SEED_SCORE), TOP_SEEDS).collect()
    seeds = [r.entity for r in good]
    if len(seeds) < 2:
        return scored.select("entity", "weight")
    selector = X.SeedSelector("FSS_SUPERVISED", seeds, n_true=min(4, len(seeds)))
    return X.iterate(pages, selector, rounds, how).select("entity", F.col("score").alias("weight"))


@dataclass(frozen=True)
class Members:
    """The members of a category (entity, weight), how sure they are (1 to 3), and the patterns that found them."""

    entities: DataFrame
    confidence: int
    patterns: DataFrame | None = None


def members(docs: DataFrame, pages: DataFrame, category: str, lang: str = "en", how: X.Expansion = X.Expansion(), phrases: Sequence[tuple[str, bool]] | None = None, min_snippets: int = MIN_SNIPPETS, hints: bool = True) -> Members:
    """The members of a category, from list phrases over ``docs`` and expansion over ``pages``.

    Instances are extracted, expanded as noisy seeds, and what both have is bootstrapped from, unless they come from the
    back-off. Confidence is that of the extraction, one more if more than three patterns were made. If nothing could be
    expanded, the extracted instances count, those that end with the category a little more.
    """
    how = replace(how, settings=replace(how.settings, phrases=(*how.settings.phrases, category)))
    first = extracted(docs, category, lang, phrases, min_snippets)
    best = stash(E.top(first.entities, TOP_SEEDS), "first")
    seeds = [r.entity for r in best.collect()]
    if len(seeds) < 2:
        return Members(best, first.confidence)
    patterns = stash(P.induce(pages, seeds, replace(how.settings, bracket=2)), "patterns")
    confidence = first.confidence + (patterns.limit(MIN_PATTERNS + 1).count() > MIN_PATTERNS)
    spread = expand_noisy(pages, best, how)
    found = spread
    if first.confidence > 1:
        scored = E.assign_score(spread).select("entity", F.col("score").alias("weight"))
        found = stash(bootstrap(pages, scored, how, category=category if hints else None, lang=lang), "grown")
    if patterns.isEmpty() or found.isEmpty():
        found = E.promote(E.assign_score(best).select("entity", F.col("score").alias("weight")), category, by="weight")
    return Members(E.shrink(E.reduce_size(E.at_least_of_max(stash(found.select("entity", "weight"), "found"), KEEP_RATIO))), confidence, patterns)


def saved_members(members_: Members, how: X.Expansion = X.Expansion()) -> DataFrame:
    """``doc, wrapper, entity, score``: the patterns of a category worth saving, scored by its members."""
    if members_.patterns is None:
        raise ValueError("the category has no patterns")
    scored = E.scored(members_.entities).select("entity", "score")
    return sinks.worthwhile(X.facts_of(members_.patterns), scored, 1)


def predict(meta: DataFrame, bad: Sequence[str] = ()) -> DataFrame:
    """``keyword, score``: what pages are about, from their keywords (doc_id, keyword, weight, title, descr): the weights
    of the pages that have it, plus the pages that have it in title or description; only keywords of at least half the
    greatest frequency."""
    k = meta.where(~F.col("keyword").isin(list(bad)) & (F.col("keyword") != "")) if bad else meta.where("keyword <> ''")
    hit = F.lower("title").contains(F.col("keyword")).cast("int"), F.lower("descr").contains(F.col("keyword")).cast("int")
    per = k.groupBy("keyword").agg(F.count_distinct("doc_id").alias("n"), F.sum("weight").alias("w"), F.sum(F.coalesce(hit[0], F.lit(0)) + F.coalesce(hit[1], F.lit(0))).alias("hits"))
    most = per.agg(F.max("n").alias("most"))
    return per.crossJoin(F.broadcast(most)).where(F.col("n") * 2 >= F.col("most")).select("keyword", (F.col("w") + F.col("n") + F.col("hits")).alias("score"))
