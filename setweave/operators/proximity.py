"""Entities near a phrase: annotated texts, chunks, counts by snippet, translation by proximity.

A snippet is a page, an excerpt a stretch of it that no sentence end cuts, a chunk a run of text that could be an entity.
Counts are plain aggregations over chunks; nothing is kept per snippet in one place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import combinations, pairwise, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setweave.functions import text as T

CUT = r"[\n\r.!?。！？।؟…]+"
SMOOTHING = 1
LAMBDA = 0.1
SIMILAR = 0.8
TWO_PIECES = 2
KEYS_AT_ONCE = 200_000
TOP = 3
MIN_SNIPPETS = 3


def excerpts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, excerpt, text``: the stretches of each text between sentence ends, numbered, blank ones left out."""
    return docs.select(id_col, F.posexplode(F.split(text_col, CUT)).alias("excerpt", "text")).where("trim(text) <> ''")


def phrase_pattern(query: str) -> str:
    """A query as a regular expression: after ``+`` its words may have any punctuation between them, else little."""
    plus = len(query) - len(query.lstrip("+"))
    words = re.split(r"\s+", query.lstrip("+").strip())
    between = rf"[{T.SPACE}!-/:-@\[-`{{-~]*" if plus else rf"[{T.SPACE}_'-]+"
    return between.join(re.escape(w) for w in words)


def around(a: int, b: int, taken: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of the stretch from ``a`` to ``b`` without those that are taken."""
    left = []
    for c, d in sorted(x for x in taken if x[0] < b and a < x[1]):
        if a < c:
            left.append((a, c))
        a = max(a, d)
    return [*left, (a, b)] if a < b else left


def annotate(texts: DataFrame, sources: Sequence[str], targets: Sequence[str], keys: Sequence[str] = ("doc_id", "excerpt"), text_col: str = "text") -> DataFrame:
    """``keys, kind, start, end``: where sources and targets stand, trimmed of punctuation; what overlaps earlier
    annotations (sources first, then as they stand in the lists) is cut around them."""
    patterns = [(kind, re.compile(phrase_pattern(p), re.I)) for kind, ps in (("source", sources), ("target", targets)) for p in ps]
    edge = re.compile(f"^{T.PUNCT}+|{T.PUNCT}+$")
    schema = texts.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, starts, ends = [], [], [], []
            for i, x in enumerate(batch.column(len(keys))):
                taken: list[tuple[int, int]] = []
                text = x.as_py()
                for kind, p in patterns:
                    for m in p.finditer(text):
                        for a, b in around(*m.span(), taken):
                            core = edge.sub("", text[a:b])
                            if core:
                                a += text[a:b].find(core)
                                taken.append((a, a + len(core)))
                                at.append(i)
                                kinds.append(kind)
                                starts.append(a)
                                ends.append(a + len(core))
            if at:
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in range(len(keys))), pa.array(kinds), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [*keys, "kind", "start", "end"])

    hints = F.lit(False)
    for p in [*sources, *targets]:
        hints = hints | F.lower(text_col).contains(max(re.split(r"\s+", p.lstrip("+").strip().lower()), key=len))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return texts.where(hints).select(*keys, text_col).mapInArrow(run, f"{fields}, kind string, start int, end int")


def proximity_score(annotations: DataFrame, keys: Sequence[str] = ("doc_id", "excerpt")) -> DataFrame:
    """``keys, score``: over the targets of a text, one over their distance to the nearest source (plus smoothing).

    A text's annotations are few (it is a sentence); texts without a source or a target have no score.
    """
    order = W.partitionBy(*keys).orderBy("start")
    before = F.last(F.when(F.col("kind") == "source", F.col("end")), True).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(F.when(F.col("kind") == "source", F.col("start")), True).over(order.rowsBetween(1, W.unboundedFollowing))
    near = annotations.withColumn("near", F.least(F.col("start") - before, after - F.col("end"))).where("kind = 'target' AND near IS NOT NULL")
    return near.groupBy(*keys).agg(F.sum(1 / (F.col("near") + 1 + SMOOTHING)).alias("score"))


def chop(text: Column, phrase: str, class_first: bool = True) -> Column:
    """What is after the first occurrence of a phrase (before it, if the class comes last); null if it isn't there."""
    pattern = phrase_pattern(phrase)
    hit = F.regexp_extract(text, f"(?i){pattern}", 0)
    at = F.position(hit, text)
    return F.when(hit != "", F.substring(text, at + F.length(hit), F.length(text)) if class_first else F.substring(text, F.lit(1), at - 1))


# Words at which a list of entities is split, and articles before an entity, by language.
SPLIT_WORDS = {"en": ("i.e", "e.g", "etc", " or ", " and ", "as well as"), "ja": ("例えば", "たとえば", "と言えば", "といえば", "と", "や", "および", "など", "とか", "が", "を", "に", "で", "は", "も"), "zh-CN": ("例如", "比如", "包括", "包含", "譬如", "等", "和", "及", "与", "或", "加", "还有", "外加", "以及", "等等", "此外", "另外"), "zh-TW": ("例如", "比如", "包括", "包含", "譬如", "等", "和", "及", "與", "或", "加", "還有", "外加", "以及", "等等", "此外", "另外"), "ko": ("등", "과", "로", "를", "이", "가", "그", "저", "도", "에", "은", "는", "을", "고", "지", "었", "와", "어", "겠", "로는", "으로", "또는", "있다", "없다", "하고", "으시", "에서", "까지", "어요", "지요", "으러", "지만", "에게", "어서", "그리고")}
BEGIN_WORDS = {"en": ("the ", "a "), "zh-CN": ("了", "说"), "zh-TW": ("了", "說"), "ja": (), "ko": ()}


def split_list(text: Column, lang: str = "en") -> Column:
    """The parts of a list in running text, trimmed; the text itself if there are none."""
    words = "|".join(re.escape(w) for w in SPLIT_WORDS[lang])
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    parts = F.filter(F.transform(F.split(padded, rf"(?i:{words})|(?<=[a-z]{{3}})\."), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(text)))


def without_article(text: Column, lang: str = "en") -> Column:
    """Text without a leading article."""
    words = "|".join(re.escape(w) for w in BEGIN_WORDS[lang])
    return F.regexp_replace(F.trim(text), f"(?i)^(?:{words})", "") if words else F.trim(text)


def chunks(text: Column, lang: str = "en", split: bool = True) -> Column:
    """The names of all chunks of a text in a language, in order, with repetitions."""
    runs = F.regexp_extract_all(text, F.lit(T.language_pattern(lang)), F.lit(0))
    if split and lang in SPLIT_WORDS:
        runs = F.flatten(F.transform(runs, lambda r: F.transform(split_list(r, lang), lambda x: without_article(x, lang))))
    return F.filter(F.transform(runs, lambda r: T.tidy(r)), lambda n: T.plausible(n) & ~T.stopped(n) & ~n.rlike("^[0-9]"))


def hierarchical_counts(found: DataFrame, snippet: str = "doc_id", excerpt: str = "excerpt", source: str = "source") -> DataFrame:
    """``entity, chunks, excerpts, snippets, sources, dist`` of rows (source, snippet, excerpt, entity[, dist])."""
    dist = F.sum("dist") if "dist" in found.columns else F.lit(None).cast("double")
    return found.groupBy("entity").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(snippet, excerpt).alias("excerpts"), F.count_distinct(snippet).alias("snippets"), F.count_distinct(source).alias("sources"), dist.alias("dist"))


def instance_scores(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``entity, score``: a quarter each for the shares of sources, snippets, excerpts and (by distance) chunks."""
    share = lambda c, t: F.when(F.col(t) > 0, F.col(c) / F.col(t)).otherwise(0.0)
    return counts.crossJoin(F.broadcast(totals)).select("entity", ((share("sources", "t_sources") + share("snippets", "t_snippets") + share("excerpts", "t_excerpts") + share("dist", "t_chunks")) / 4).alias("score"))


def totals(found: DataFrame, snippet: str = "doc_id", excerpt: str = "excerpt", source: str = "source") -> DataFrame:
    """One row of all sources, snippets, excerpts and chunks."""
    return found.agg(F.count_distinct(source).alias("t_sources"), F.count_distinct(snippet).alias("t_snippets"), F.count_distinct(snippet, excerpt).alias("t_excerpts"), F.count(F.lit(1)).alias("t_chunks"))


def translation_scores(weights: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """``source, entity, score`` of weights ``source, entity, weight``: how likely a target is for its source, and how
    unlikely for the others, with add-one smoothing."""
    per = weights.groupBy("source").agg(F.sum("weight").alias("in_source"), F.count(F.lit(1)).alias("targets"))
    entity = weights.groupBy("entity").agg(F.sum("weight").alias("in_all"))
    whole = weights.agg(F.sum("weight").alias("everything"), F.count_distinct("entity").alias("entities"))
    own = (F.col("weight") + 1) / (F.col("in_source") + F.col("targets"))
    rest = (F.col("in_all") - F.col("weight") + 1) / (F.col("everything") - F.col("in_source") + F.col("entities"))
    return weights.join(per, "source").join(entity, "entity").crossJoin(F.broadcast(whole)).select("source", "entity", (lam * own + (1 - lam) * (1 - rest)).alias("score"))


def _edits(m: int, n: int, similarity: float) -> int:
    """Most edits between similar names of lengths ``m`` and ``n``; -1 if their lengths alone differ by more."""
    d = int(math.floor((1 - similarity) * max(m, n) + 1e-9))
    return d if abs(m - n) <= d else -1


def _segments(n: int, k: int) -> list[tuple[int, int]]:
    """Starts and lengths of ``k`` nearly equal pieces of a string of length ``n``."""
    base, longer = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = base + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


@cache
def _pieces(n: int, d: int, m: int | None = None) -> list[tuple[str, list[tuple[int, int]]]]:
    """Labels and stretches of the pieces by which a name of length ``n`` meets others at most ``d`` edits away; with ``m``,
    the stretches of a name of length ``m`` in which they may stand.

    Of ``d`` edits and ``d + k`` pieces there are always ``k`` pieces that no edit touches, with at most as many edits
    before, between and after them as pieces, so none stands further from its place than those. Names a few edits apart
    are short: they are cut once more and meet by two pieces, as one is too common.
    """
    k = 2 if 0 < d <= TWO_PIECES else 1
    cut, found = _segments(n, d + k), []
    for chosen in combinations(range(d + k), k):
        for moved in [(0,) * k] if m is None else product(range(-d, d + 1), repeat=k):
            stops = [(-1, 0), *zip(chosen, moved), (d + k, (n if m is None else m) - n)]
            if m is None or all(abs(t - s) < j - i for (i, s), (j, t) in pairwise(stops)):
                at = [(cut[i][0] + s, cut[i][0] + s + cut[i][1]) for i, s in zip(chosen, moved)]
                if all(0 <= p and q <= (n if m is None else m) for p, q in at):
                    found.append((f"{n}/{d}/{chosen}/", at))
    return found


def _keys(probe: bool, similarity: float, columns: Sequence[str]):
    """A row for each key of a name, with the ``columns`` after it; where names are not probes, the last column is not one of
    them but the lengths of the probes."""

    def cuts(n: int, lengths: Sequence[int]) -> list[tuple[str, list[tuple[int, int]]]]:
        if not probe:
            return [x for d in sorted({_edits(m, n, similarity) for m in lengths} - {-1}) for x in _pieces(n, d)]
        near = range(math.ceil(similarity * n - 1e-9), int(n / similarity + 1e-9) + 1)
        return [x for m in near if (d := _edits(n, m, similarity)) >= 0 for x in _pieces(m, d, n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple[str, list[tuple[int, int]]]]] = {}
        for batch in batches:
            at, keys = [], []
            for i, x in enumerate(batch.column(0)):
                s = x.as_py()
                if len(s) not in known:
                    known[len(s)] = cuts(len(s), () if probe else batch.column(len(columns))[i].as_py())
                found = {label + "".join([s[p:q] for p, q in stretches]) for label, stretches in known[len(s)]}
                keys += found
                at += [i] * len(found)
                if at and (len(at) >= KEYS_AT_ONCE or i + 1 == len(batch)):
                    where = pa.array(at)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in range(len(columns))), pa.array(keys, pa.string())], [*columns, "key"])
                    at, keys = [], []

    return run


def similar_pairs(a: DataFrame, b: DataFrame, similarity: float = SIMILAR, keep: Sequence[str] = ()) -> DataFrame:
    """``name_a, name_b, keep, similarity`` of all names of two lists (column ``name``) whose edit similarity is at least
    ``similarity``, with the columns of the second list that are to be kept. No pair is missed.

    Candidates meet by an equi-join on hashes of pieces, which is a sort-merge join: keys are many times the names, which
    the planner can't know, so it would gather them in the driver to broadcast them.
    """
    some = a.select("name").where("name <> ''").distinct()
    n = F.length("name")
    fits = lambda m: F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9
    lengths = some.agg(F.collect_set(n).alias("_lengths"))
    others = b.select("name", *keep).where("name <> ''").distinct().crossJoin(F.broadcast(lengths)).where(F.exists("_lengths", fits))
    others = others.select("name", *keep, F.filter("_lengths", fits).alias("_lengths"))
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in b.select(*keep).schema)
    left = some.mapInArrow(_keys(True, similarity, ["name"]), "name string, key string").select(F.col("name").alias("name_a"), F.hash("key").alias("key"))
    right = others.mapInArrow(_keys(False, similarity, ["name", *keep]), f"name string{kept}, key string").select(F.col("name").alias("name_b"), *keep, F.hash("key").alias("key"))
    x, y = F.col("name_a"), F.col("name_b")
    most = F.floor((1 - similarity) * F.greatest(F.length(x), F.length(y)) + 1e-6).cast("int")
    near = left.hint("merge").join(right, "key").where(F.call_function("levenshtein", x, y, most) >= 0)  # gives up beyond most
    return near.select("name_a", "name_b", *keep).distinct().withColumn("similarity", T.edit_similarity(x, y)).where(F.col("similarity") >= similarity - 1e-12)


def top_targets(scores: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best targets of each source."""
    order = W.partitionBy("source").orderBy(F.col("score").desc(), "entity")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def round_trip(forward: DataFrame, backward: DataFrame, similarity: float = SIMILAR, k: int = TOP) -> DataFrame:
    """``source, target, weight``: for each source the target whose own best targets lead back to (nearly) the source."""
    there = top_targets(forward, k).select("source", F.col("entity").alias("target"), F.col("score").alias("w1"))
    back = top_targets(backward, k).select(F.col("source").alias("target"), F.col("entity").alias("back"), F.col("score").alias("w2"))
    trips = there.join(back, "target").withColumn("s", T.edit_similarity(F.col("back"), F.col("source"))).where(F.col("s") >= similarity)
    best = F.max(F.struct((F.col("w1") * F.col("w2") * F.col("s")).alias("weight"), "target")).alias("b")
    return trips.groupBy("source").agg(best).select("source", "b.target", "b.weight")


def cross_verify(translations: DataFrame, other: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """``source, entity, weight``: for each source the entity of the other list that is nearest to one of its translations,
    by translation's score times entity's weight times similarity."""
    near = similar_pairs(translations.select(F.col("entity").alias("name")), other.select(F.col("entity").alias("name"), "weight"), similarity, ["weight"])
    joined = translations.join(near, translations["entity"] == near["name_a"])
    best = F.max(F.struct((F.col("score") * F.col("weight") * F.col("similarity")).alias("w"), F.col("name_b").alias("e"))).alias("b")
    return joined.groupBy("source").agg(best).select("source", F.col("b.e").alias("entity"), F.col("b.w").alias("weight"))


def legacy_scores(found: DataFrame, n_snippets: int, n_excerpts: int) -> DataFrame:
    """``entity, score``: the older translator's sum of logarithms of smoothed shares, less that of being a part of others.

    ``found`` has entity, doc_id, excerpt (-1 for a title), dist and ``inside`` (a part of a longer chunk).
    """
    per = found.groupBy("entity").agg(F.count(F.lit(1)).alias("cf"), F.count_distinct("doc_id").alias("csf"), F.count_distinct(F.when(F.col("excerpt") < 0, F.col("doc_id"))).alias("ctf"), F.count_distinct(F.when(F.col("excerpt") >= 0, F.struct("doc_id", "excerpt"))).alias("cef"), F.sum("dist").alias("dist"), F.count_if("inside").alias("sf"))
    logs = per.agg(F.sum(F.when(F.col("cf") > 0, F.log("cf"))).alias("t_cf"), F.sum(F.when(F.col("sf") > 0, F.log("sf"))).alias("t_sf"), F.sum("dist").alias("t_dist"))
    ratio = lambda a, b: F.log((F.col(a) + 1) / (b + 1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = ratio("cf", zero("t_cf")) + ratio("csf", F.lit(n_snippets)) + ratio("ctf", F.lit(n_snippets)) + ratio("cef", F.lit(n_excerpts)) + F.log(F.col("dist") / F.col("t_dist")) - ratio("sf", zero("t_sf"))
    return per.crossJoin(F.broadcast(logs)).select("entity", score.alias("score"))


def collapsed(scores: DataFrame) -> DataFrame:
    """``entity, score`` without names that are a part of a name before them in the order of scores (then of names).

    As a part of a part is a part, it doesn't matter whether the longer name stays itself. Every name gives its parts of
    the lengths that names have, of which only the first owner is kept, so names meet by an equi-join.
    """
    rank = F.struct((-F.col("score")).alias("s"), F.col("entity").alias("e"))
    n = F.length("entity")
    lengths = scores.where("entity <> ''").agg(F.collect_set(n).alias("_lengths"))
    shorter = F.filter("_lengths", lambda k: k < n)
    parts = F.flatten(F.transform(shorter, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring("entity", i, k))))
    owners = scores.crossJoin(F.broadcast(lengths)).select(F.explode(F.array_distinct(parts)).alias("part"), rank.alias("r")).groupBy("part").agg(F.min("r").alias("r"))
    joined = scores.join(owners, scores["entity"] == owners["part"], "left")
    return joined.where(F.col("r").isNull() | (F.col("r") >= rank)).select("entity", "score")
