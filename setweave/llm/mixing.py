"""Mixing sources to target shares of all tokens by entropy balancing.

Every document gets a rate, the expected number of its copies. Of all rates that give each source its tokens, none above
the source's limit of repeats, those are taken that stay closest (in entropy) to using every document once. The convex
dual has one variable per source, and the rates come out exponentially tilted by a document's tokens:
``min(max_repeats, exp(lambda * tokens))``. Newton's iterations run over the counts of (source, tokens), which are all
that the dual depends on; a round is one distributed aggregation that returns one row per source. Rates are then rounded
to copies by a hash of the document, with a threshold per source that makes the tokens come out right to a document.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setweave.runtime import stash

#: Where the vocabulary files of public tokenizers are.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the public byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sizes of a mix beside a number of tokens: as many tokens as the sources with targets hold, whatever is out of reach
#: then; or the most at which every source with tokens reaches its share.
ALL, REACHABLE = "all", "reachable"
#: Most sources that a table of targets may have: their parameters are kept on the driver and joined as a table.
MAX_SOURCES = 100_000
NEWTON_ROUNDS = 60
TOLERANCE = 1e-9
BINS = 4096
BIN_ROUNDS = 3

_encodings: dict = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


#: Runs of white space that are given to the merging of bytes as the one piece that they are: the tokenizer's splitter
#: backs up in long ones.
_SPACE_RUN = re.compile(r"\s{1000,}")


def n_tokens(text: str, encoding) -> int:
    """Tokens of ``text``. A long run of white space is a piece without its last character, or whole at the text's end."""
    total, at = 0, 0
    for m in _SPACE_RUN.finditer(text):
        end = m.end() - (m.end() < len(text))
        if m.start() > at:
            total += len(encoding.encode_ordinary(text[at : m.start()]))
        total += len(encoding._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens`` of ``docs`` (same columns, with ``text``); null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            sizes = [n_tokens(x.as_py(), encoding) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, source string, tokens bigint")


def source_name(c: Column) -> Column:
    """A source's name without its spelling: trimmed of any white space and lower-cased; null and blank are no source."""
    name = F.lower(F.regexp_replace(c, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", ""))
    return F.when(name != "", name)


@dataclass
class Source:
    """A source's target and what is known of its documents."""

    name: str
    share: float
    limit: int
    tokens: int = 0
    docs: int = 0
    wanted: float = 0.0  # tokens it is to give
    tilt: float = 0.0
    threshold: float = -2.0
    saturated: bool = False
    short: bool = False
    bounds: list = field(default_factory=lambda: [-math.inf, math.inf])

    @property
    def most(self) -> int:
        return self.limit * self.tokens

    @property
    def scale(self) -> float:
        return self.docs / self.tokens if self.tokens else 0.0


def _budget(sources: list[Source], total: int | str) -> None:
    """What each source is to give. Sources that can't reach their share of the total give all they can, and the others
    fill up in proportion to their shares."""
    able = [s for s in sources if s.most > 0 and s.share > 0]
    if not able:
        return
    if total == REACHABLE:
        weight = sum(s.share for s in able)
        total = min(sum(s.tokens for s in able), min(s.most * weight / s.share for s in able))
    elif total == ALL:
        total = sum(s.tokens for s in able)
    left, free, shares = float(total), list(able), sum(s.share for s in able)
    for s in able:
        s.short = total * s.share / shares > s.most * (1 + 1e-9)
    while free:
        weight = sum(s.share for s in free)
        short = [s for s in free if left * s.share / weight >= s.most * (1 - 1e-12)]
        if not short:
            for s in free:
                s.wanted = left * s.share / weight
            return
        for s in short:
            s.wanted, s.saturated = float(s.most), True
            left -= s.most
        free = [s for s in free if not s.saturated]


def _with(table: DataFrame, sources: list[Source], **values: Callable[[Source], float]) -> DataFrame:
    """``table`` joined with parameters of the sources; rows of other sources are left out."""
    rows = [(s.name, *[float(v(s)) for v in values.values()]) for s in sources]
    parameters = table.sparkSession.createDataFrame(rows, "source string, " + ", ".join(f"{k} double" for k in values))
    return table.join(F.broadcast(parameters), "source")


def _solve(sources: list[Source], counts: DataFrame) -> None:
    """Newton's iterations for all sources at once, kept within the bounds that are known (the dual is convex)."""
    todo = [s for s in sources if s.wanted > 0 and not s.saturated]
    for _ in range(NEWTON_ROUNDS):
        if not todo:
            return
        t, n = F.col("tokens").cast("double"), F.col("n").cast("double")
        x = t * F.col("scale")
        rate = F.exp(F.least(x * F.col("tilt"), F.col("cap")))
        slope = F.when(x * F.col("tilt") < F.col("cap"), n * t * x * rate).otherwise(0.0)
        rows = _with(counts, todo, scale=lambda s: s.scale, tilt=lambda s: s.tilt, cap=lambda s: math.log(s.limit)).groupBy("source").agg(F.sum(n * t * rate).alias("given"), F.sum(slope).alias("slope")).collect()
        by = {r["source"]: r for r in rows}
        for s in list(todo):
            r = by[s.name]
            gap = r["given"] - s.wanted
            if abs(gap) <= TOLERANCE * s.wanted:
                todo.remove(s)
                continue
            s.bounds[gap > 0] = s.tilt
            low, high = s.bounds
            step = s.tilt - gap / r["slope"] if r["slope"] > 0 else math.nan
            if not low < step < high:
                step = (low + high) / 2 if math.isfinite(low + high) else (s.tilt * 2 + 1 if gap < 0 else s.tilt * 2 - 1)
            if step in (low, high):
                todo.remove(s)
            s.tilt = step


def _rated(docs: DataFrame, sources: list[Source], seed: int) -> DataFrame:
    """``docs`` with ``rate, whole, draw``: a document's fraction becomes a copy if its draw is below the threshold."""
    used = [s for s in sources if s.wanted > 0]
    given = _with(docs, used, scale=lambda s: s.scale, tilt=lambda s: s.tilt, limit=lambda s: s.limit, full=lambda s: s.saturated)
    x = F.col("tokens") * F.col("scale") * F.col("tilt")
    rate = F.when(F.col("full") == 1.0, F.col("limit")).otherwise(F.exp(F.least(x, F.log("limit"))))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11)) / F.lit(float(1 << 53))
    rated = given.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-9))
    return rated.withColumn("draw", F.when(F.col("whole") < F.col("limit"), unit - (F.col("rate") - F.col("whole")))).drop("scale", "tilt", "limit", "full")


def _thresholds(sources: list[Source], rated: DataFrame) -> None:
    """The threshold of each source at which the copies' tokens come nearest to what it is to give.

    The draws' tokens are summed in bins, of which the one where the running sum reaches the aim is cut into bins again;
    the running sums are taken by the tasks, a row for each source comes back.
    """
    todo = [s for s in sources if s.wanted > 0 and not s.saturated]
    whole = {r["source"]: r["t"] for r in rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).cast("double").alias("t")).collect()}
    window = {s.name: (-1.0, 1.0, whole.get(s.name, 0.0)) for s in todo}
    for turn in range(BIN_ROUNDS if todo else 0):
        low, high, have = (lambda s, k=k: window[s.name][k] for k in range(3))
        inside = _with(rated, todo, low=low, high=high, have=have, wanted=lambda s: s.wanted).where((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high")))
        place = F.floor((F.col("draw") - F.col("low")) / (F.col("high") - F.col("low")) * BINS).cast("int")
        bins = inside.groupBy("source", "have", "wanted", place.alias("bin")).agg(F.sum("tokens").alias("t"))
        upto = F.col("have") + F.sum("t").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        over = bins.withColumn("upto", upto).where(F.col("upto") > F.col("wanted")).groupBy("source").agg(F.min(F.struct("bin", "upto", "t")).alias("m"))
        hits = {r["source"]: r["m"] for r in over.collect()}
        for s in todo:
            a, b, _ = window[s.name]
            width = (b - a) / BINS
            if s.name not in hits:  # all of them together don't exceed the aim
                window[s.name], s.threshold = (b, b, 0.0), b
                continue
            hit = hits[s.name]
            begin, end, before = a + hit["bin"] * width, min(a + (hit["bin"] + 1) * width, b), hit["upto"] - hit["t"]
            window[s.name] = (begin, end, before)
            nearer = turn == BIN_ROUNDS - 1 and hit["upto"] - s.wanted < s.wanted - before
            s.threshold = end if nearer else begin
        todo = [s for s in todo if s.name in hits]


@dataclass(frozen=True)
class Mix:
    """A mix: ``copies`` has the documents used (doc_id, source, tokens, rate, copies), ``shares`` a row per target."""

    copies: DataFrame
    shares: DataFrame


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | str, vocabulary: str = VOCABULARY, seed: int = 7) -> Mix:
    """Documents with their numbers of copies so that each source has its target share of all tokens.

    ``docs`` has doc_id, source, text; ``targets`` source, target_share, max_repeats. Spellings of a source are one.
    ``total_tokens`` is the size of the mix: a number, ``ALL`` or ``REACHABLE``. Documents without a source, of a source
    without a target, or without tokens are not used. ``shares`` reports for every target the tokens and the share
    reached and whether it was in reach (a source without tokens is not, nor one whose limit of repeats is too low for
    the total; the others then fill up in proportion to their shares).
    """
    if isinstance(total_tokens, str) and total_tokens not in (ALL, REACHABLE):
        raise ValueError(f"total_tokens is a number, {ALL!r} or {REACHABLE!r}")
    spark = docs.sparkSession
    rows = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("limit")).where("source IS NOT NULL AND share > 0 AND limit > 0").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have targets")
    sources = [Source(r["source"], r["share"], r["limit"]) for r in rows]
    if len({s.name for s in sources}) < len(sources):
        raise ValueError("a source has two targets")
    sized = stash(count_tokens(docs.select("doc_id", source_name(F.col("source")).alias("source"), "text"), vocabulary), "sized").where("tokens > 0 AND source IS NOT NULL")
    counts = stash(sized.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "counts")
    known = {r["source"]: r for r in _with(counts, sources, share=lambda s: s.share).groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    for s in sources:
        if s.name in known:
            s.tokens, s.docs = known[s.name]["t"], known[s.name]["n"]
    _budget(sources, total_tokens)
    _solve(sources, counts)
    rated = stash(_rated(sized, sources, seed), "rated")
    _thresholds(sources, rated)
    used = [s for s in sources if s.wanted > 0]
    extra = F.when(F.col("draw") < F.col("threshold"), 1).otherwise(0)
    copies = _with(rated, used, threshold=lambda s: s.threshold).withColumn("copies", (F.col("whole") + extra).cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "rate", "copies")
    plan = spark.createDataFrame([(s.name, s.share, s.limit, s.tokens, s.wanted > 0 and not s.short) for s in sources], "source string, target_share double, max_repeats int, source_tokens bigint, in_reach boolean")
    given = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    shares = plan.join(given, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    everything = given.agg(F.sum("tokens").alias("all_tokens"))
    shares = shares.crossJoin(F.broadcast(everything)).withColumn("reached_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))).drop("all_tokens")
    return Mix(copies, shares)
