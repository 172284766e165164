"""Temperature mixing of sources under a token budget.

Source shares of all tokens are raised to an exponent and normalised.  The
exponent is found by section of [0, 1]: the largest one whose weights reach a
target entropy, raised if need be until no source repeats beyond a limit.  Each
source's budget is then laid out as passes over a permutation of its documents:
whole passes, and a last one up to the document where the budget is used up.

The permutation is the order of md5 of (seed, source, id).  Its blocks are the
ranges of equal leading hex digits: block sums find the block in which a source's
budget ends, and only that block is ordered row by row.  A decision is then a
comparison with one threshold per source, so texts are never shuffled and a
source with a third of all rows is no harder than others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which per-source rows are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
NULL = "\x00null"


@dataclass(frozen=True)
class Target:
    """evenness: entropy of the weights over that of equal weights; repeats: most passes over a source.

    Of two targets that contradict each other the limit on repeats holds.
    """

    evenness: float | None = None
    repeats: float | None = None


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _section(totals: DataFrame, holds, rising: bool, points: int = 16, rounds: int = 9) -> float:
    """Where ``holds(S0, S1)`` changes on [0, 1], S0 and S1 being the sums of p ** a and p ** a * ln p.

    rising: it holds from that exponent on; else up to it.  A round evaluates all its
    points in one aggregation; the interval shrinks by ``points + 1`` each time.
    """
    low, high = 0.0, 1.0
    ln = F.log("share")

    def at(xs: list[float]) -> list[bool]:
        powers = [F.exp(ln * x) for x in xs]
        row = totals.where("share > 0").agg(*[F.sum(p).alias(f"a{i}") for i, p in enumerate(powers)], *[F.sum(p * ln).alias(f"b{i}") for i, p in enumerate(powers)]).first()
        return [holds(x, row[f"a{i}"], row[f"b{i}"]) for i, x in enumerate(xs)]

    first, last = at([low, high])
    if rising and first or not rising and not first:
        return low
    if not rising and last or rising and not last:
        return high
    for _ in range(rounds):
        xs = [low + (high - low) * (i + 1) / (points + 1) for i in range(points)]
        truth = at(xs)
        k = sum(t != rising for t in truth)
        low, high = (xs[k - 1] if k else low), (xs[k] if k < points else high)
    return (low + high) / 2


def exponent(totals: DataFrame, target: Target, budget: float, total: float, sources: int, least_share: float) -> float:
    """The exponent, to six decimals. totals: a row per source with its ``share``."""
    a = 1.0
    if target.evenness is not None and sources > 1:
        goal = target.evenness * math.log(sources) - 1e-12
        a = _section(totals, lambda x, s0, s1: math.log(s0) - x * s1 / s0 >= goal, rising=False)
    if target.repeats is not None:
        # The smallest source repeats most: its weight times the budget over its tokens.
        def allowed(x: float, s0: float, _: float) -> bool:
            return least_share**x / s0 * budget <= target.repeats * least_share * total * (1 + 1e-12)

        a = max(a, _section(totals, allowed, rising=True))
    return round(a, 6)


def mix(docs: DataFrame, target: Target, budget: int | None = None, seed: int = 0, tokens: Column | None = None, block_rows: int = 4096, names: tuple[str, str] = ("n_tokens", "copies")) -> DataFrame:
    """``docs`` with ``n_tokens long`` and ``copies long``: how often a document is drawn.

    budget: tokens to draw, by default as many as there are.  tokens: the size of a
    document, by default its words.  The drawn tokens of a source exceed its budget
    never, and fall short by less than the document at which it ends.  A null
    source is a source of its own; documents without tokens are drawn in whole
    passes, and in the last one up to its end.  Rows of one source and id have one
    place in the permutation and are drawn alike.  A source without tokens, and all
    sources of an empty table, are drawn no times.  Input columns with the ``names``
    of the two results are replaced; names beginning with ``__mix_`` are
    reserved.  Only ``doc_id``, ``source`` and ``text`` are read.
    """
    size = n_words(F.col("text")) if tokens is None else tokens
    source = F.coalesce(F.col("source").cast("string"), F.lit(NULL))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), source, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    slim = cut(docs.select(source.alias("source"), place.alias("place"), size.alias("n")))
    sums = slim.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    sums = cut(sums)
    total, sources, most, least = sums.agg(F.sum("tokens"), F.count(F.when(F.col("tokens") > 0, 1)), F.max("docs"), F.min(F.when(F.col("tokens") > 0, F.col("tokens")))).first()
    if not total:
        return docs.withColumns({names[0]: size, names[1]: F.lit(0).cast("long")})
    budget = total if budget is None else budget
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(total)))
    a = exponent(shares, target, float(budget), float(total), sources, least / total)
    norm = shares.where("share > 0").agg(F.sum(F.pow("share", F.lit(a)))).first()[0]
    want = F.when(F.col("tokens") > 0, F.pow("share", F.lit(a)) / norm * float(budget)).otherwise(0.0)
    plan = shares.select("source", "tokens", F.floor(want + 1e-6).cast("long").alias("want"))
    whole = F.when(F.col("tokens") > 0, F.expr("want div tokens")).otherwise(0)
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("want") - F.col("whole") * F.col("tokens"))
    small = (lambda df: F.broadcast(df)) if sums.count() <= BROADCAST_SOURCES else (lambda df: df)

    digits = max(1, math.ceil(math.log(max(most / block_rows, 1), 16)))
    block = F.substring("place", 1, digits)
    blocks = slim.groupBy("source", block.alias("block")).agg(F.sum("n").alias("n"))
    by_block = W.partitionBy("source").orderBy("block")
    blocks = blocks.withColumn("upto", F.sum("n").over(by_block.rowsBetween(W.unboundedPreceding, 0)))
    ends = blocks.join(small(plan), "source").where("upto > rest").groupBy("source").agg(F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("before"), "rest")).alias("e"))
    ends = ends.select("source", "e.*")
    inside = slim.withColumn("block", block).join(small(ends), ["source", "block"])
    by_row = W.partitionBy("source").orderBy("place").rangeBetween(W.unboundedPreceding, W.currentRow)
    taken = inside.withColumn("upto", F.col("before") + F.sum("n").over(by_row)).where("upto <= rest").groupBy("source").agg(F.max("place").alias("last"))
    # Places up to the threshold are in the last pass: the last one taken, else all before the block.
    limits = ends.join(taken, "source", "left").select("source", F.coalesce("last", F.col("block")).alias("__mix_last"))
    plan = cut(plan.join(limits, "source", "left").select(F.col("source").alias("__mix_source"), F.col("whole").alias("__mix_whole"), "__mix_last"))
    drawn = F.col("__mix_whole") + (F.col("__mix_place") <= F.col("__mix_last")).cast("long")
    found = docs.withColumns({"__mix_n": size, "__mix_source": source, "__mix_place": place}).join(small(plan), "__mix_source")
    found = found.withColumns({names[0]: F.col("__mix_n"), names[1]: F.coalesce(drawn, F.lit(0)).cast("long")})
    return found.drop("__mix_n", "__mix_source", "__mix_place", "__mix_whole", "__mix_last")


def realise(mixed: DataFrame, names: tuple[str, str] = ("n_tokens", "copies")) -> DataFrame:
    """Every document as often as it is drawn, without the columns of ``mix``, whose ``names`` are given.

    Nulls, empty texts and repeated rows are laid out like others; rows drawn no
    times, all of an empty table, go.
    """
    rows = mixed.where(F.col(names[1]) > 0).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[1]))))
    return rows.drop("__mix_copy", *names)
