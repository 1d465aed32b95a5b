"""Temperature mixing of sources, in DataFrame functions only.

The token shares p of the sources are raised to an exponent a and normalised; below 1 the sources come closer, at 0
all are alike, above 1 large ones gain. The entropy of the weights falls as a rises, and the greatest number of passes
through a source grows with the distance of a from 1. Bisection, some points at a time, finds the exponent of the
asked entropy; a limit on passes bounds the exponent on either side of 1, and where both are asked for the nearest
exponent within these bounds is taken. An entropy that no exponent has is an error. The weights become a budget of
tokens for each source, spent in epochs: whole passes, then a part of one. Within an epoch the documents go through a
keyed permutation of blocks, and of the documents in each; a running count of tokens says where the budget ends and
which block of the mixture a document falls into, so every block of the mixture has the weights of the whole.

A source may hold any share of the rows: its documents are dealt over blocks of about ``BLOCK_ROWS``, and only
sums of blocks meet. Texts are read once, for their number of words.

Defined cases: a null source is a source of its own; a null or empty text counts as one token; repeated rows count
and are drawn each on its own; a single source has weight 1, whatever the asked entropy; an empty table gives no rows;
columns that are not asked for are ignored, whatever their names, but for their part in ``row_key``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import NO_ID, fresh, row_key, written

#: Documents of a block of the permutation, on average, and tokens of a block of the mixture.
BLOCK_ROWS = 4096
MIX_TOKENS = 1_000_000
SEED = 20_240_501
#: Points of a bisection step, and steps: the exponent is exact to 32 ** -4 where it is below 1.
POINTS, STEPS = 32, 4


def tokens(text: Column) -> Column:
    """Words parted by white space, one at least."""
    return F.coalesce(F.greatest(F.size(F.split(F.trim(text), r"\s+")), F.lit(1)), F.lit(1)).cast("long")


def _curve(totals: DataFrame, total: int, top: int, points: list[float]) -> dict[float, dict]:
    """Entropy, norm (the largest source has 1) and greatest over-weight at each exponent; as many rows as points come back."""
    lp = F.log(F.col("t") / F.lit(float(total)))
    each = totals.select(lp.alias("lp"), (lp - F.lit(math.log(top / total))).alias("d"), F.explode(F.array(*map(F.lit, points))).alias("a"))
    power = F.exp(F.col("a") * F.col("d"))
    got = each.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.col("a") * F.col("d")).alias("s"), F.max(F.col("a") * F.col("d") - F.col("lp")).alias("over"))
    return {r["a"]: {"entropy": math.log(r["z"]) - r["s"] / r["z"], "norm": r["z"], "over": r["over"]} for r in got.collect()}


def exponent(totals: DataFrame, total: int, top: int, n: int, entropy: float | None, repeats: float | None, budget: float | None) -> float:
    """The exponent whose weights have the asked entropy (a share of log n), or the nearest that repeats no source too often.

    Without an entropy the least exponent that keeps the limit on repeats. Without a budget every document is to be
    drawn once at least, so the largest source sets the scale and no exponent is above 1.
    """

    def search(points: list[float], holds: Callable[[dict], bool]) -> tuple[float, float]:
        """Neighbours between which a condition, which holds from some exponent on, begins to hold; equal ones if it holds at once."""
        for _ in range(STEPS):
            found = _curve(totals, total, top, points)
            at = next((k for k, a in enumerate(points) if holds(found[a])), None)
            if at is None:
                return math.inf, math.inf
            if at == 0:
                return points[0], points[0]
            low, high = points[at - 1], points[at]
            points = [low + (high - low) * k / POINTS for k in range(POINTS + 1)]
        return low, high

    def passes(r: dict) -> float:
        return math.exp(r["over"]) * (budget / total / r["norm"] if budget else top / total)

    whole = [k / POINTS for k in range(POINTS + 1)]
    rising = [1.0, *(1 + 2.0**k for k in range(-4, 11))]
    asked = None
    if entropy is not None:
        asked = search(whole if not budget else whole[:-1] + rising, lambda r: r["entropy"] <= entropy * math.log(n) + 1e-12)[1]
        if math.isinf(asked) or (asked == 0 and entropy < 1 - 1e-12):
            raise ValueError(f"no exponent gives weights of {n} sources an entropy of {entropy} of the greatest")
    if repeats is None:
        return 0.0 if asked is None else asked
    least = search(whole, lambda r: passes(r) <= repeats + 1e-9)[1]
    if math.isinf(least):
        raise ValueError(f"{budget} of {total} tokens cannot be drawn in {repeats} passes")
    if asked is None or asked <= least:
        return least
    most = search(rising, lambda r: passes(r) > repeats + 1e-9)[0] if asked > 1 else asked
    return min(asked, most)


def mix(docs: DataFrame, entropy: float | None = 0.95, repeats: float | None = 4.0, budget: float | None = None, cover: bool = False, seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, source, n_tokens, source_weight, epoch, mix_block, order_key): the documents drawn, in order of the last two.

    ``budget``: tokens to draw; by default as many as there are, or with ``cover`` so many that each document is drawn at least once.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row_key"), F.col("source").cast("string").alias("source"), tokens(F.col("text")).alias("n_tokens"))
    known = written(known.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))), "mixed")
    totals = written(known.groupBy("key").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("rows")), "sources")
    head = totals.agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"), F.max("t").alias("top")).first()
    total, n, top = head["t"] or 1, head["n"], head["top"] or 1
    asked = None if cover else float(budget or total)
    a = exponent(totals, total, top, n, entropy, repeats, asked) if n > 1 else 1.0
    power = F.exp(F.lit(a) * (F.log(F.col("t") / F.lit(float(total))) - F.lit(math.log(top / total))))
    z = totals.agg(F.sum(power).alias("z")).first()["z"] or 1.0
    weight = power / F.lit(z)
    spend = asked if asked is not None else top * z
    plan = totals.select("key", "t", F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("long").alias("blocks"), weight.alias("source_weight"), (weight * F.lit(float(spend))).alias("share"))
    drawn = known.join(plan, "key")
    # A share that falls short of a pass by rounding alone is a whole pass.
    epochs = F.greatest(F.lit(1), F.ceil(F.col("share") / F.col("t") - F.lit(1e-9))).cast("int")
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    chance = F.xxhash64(F.lit(seed), "epoch", "key", "doc_id", "row_key")
    drawn = drawn.withColumn("chance", chance).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "chance"), F.col("blocks")))
    by = ["key", "epoch", "block"]
    sums = drawn.groupBy(*by).agg(F.sum("n_tokens").alias("of_block"))
    earlier = F.sum("of_block").over(Window.partitionBy("key", "epoch").orderBy(F.xxhash64(F.lit(seed), "block"), "block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, F.coalesce(earlier, F.lit(0)).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy(*by).orderBy("chance", "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    drawn = drawn.join(sums, by).withColumn("at", F.col("before") + F.coalesce(within, F.lit(0)) + F.col("epoch") * F.col("t"))
    blocks = max(1, round(spend / MIX_TOKENS))
    place = F.least(F.floor(F.col("at") / F.greatest("share", F.lit(1e-9)) * blocks), F.lit(blocks - 1)).cast("int")
    return drawn.where(F.col("at") < F.col("share") + F.lit(1e-6)).select("doc_id", "row_key", "source", "n_tokens", "source_weight", "epoch", place.alias("mix_block"), F.xxhash64(F.lit(seed + 2), "chance").alias("order_key"))


def mixed_documents(docs: DataFrame, entropy: float | None = None, repeats: float | None = 2.0, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mixture draws them, every row at least once."""
    own, key, times, row = (fresh(docs, x) for x in ("mix_id", "mix_key", "mix_copies", "mix_row"))
    # Plain equalities of the same columns on both sides, so that the rows are dealt out once.
    number = lambda df: F.coalesce(df["doc_id"].cast("long"), F.lit(NO_ID))
    # A row's copies are counted by blocks of the mixture, so no task makes more of them than a block holds.
    drawn = mix(docs, entropy, repeats, cover=True, seed=seed)
    copies = drawn.groupBy(number(drawn).alias(own), F.col("row_key").alias(key), "mix_block").agg(F.count(F.lit(1)).alias("n")).drop("mix_block")
    # Repeated rows share both keys; one of them stands for all, chosen before the shuffle as well as after it.
    rows = docs.groupBy(number(docs).alias(own), row_key(docs).alias(key)).agg(F.first(F.struct(*docs.columns)).alias(row))
    found = rows.join(copies, [own, key])
    return found.select(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias(times)).select(f"{row}.*")
