"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent and normalised: w = p^a / sum(p^a).  The exponent is found by
repeated section between 0 (uniform) and 1 (as it is): the entropy of w must reach a share of the largest possible
entropy, yet no source may be passed over more often than the repetition limit.  The weights become token budgets,
and each budget is realised on blocks of documents: every full pass takes all blocks of the source in a fresh seeded
permutation, the last pass takes blocks in its permutation until the budget is met, and the block at the edge gives
documents in a permutation of its own.  Without an explicit budget the smallest one is taken that passes over every
source at least once, so that no document is lost.  The repetition limit holds for any budget: a larger budget needs a
larger exponent, and one that even the shares as they are cannot meet is cut to as many passes as the limit allows.

A document's tokens are its white-space words here, or one for every BYTES_A_TOKEN bytes of UTF-8 if that is more, so
that text without spaces counts by its size; ``n_tokens`` takes any other count, such as a tokenizer's.

The section needs only sums over sources, taken by Spark; sources are never collected.  A source has blocks of
``block_tokens`` tokens, but ``most_blocks`` at most: in larger sources blocks grow instead, so that no window holds more
rows than that or one block's documents.

Defined results: a null or empty text counts one token, as each document does at least; a text of any length is counted
whole; null is a source of its own; rows that repeat count as separate documents, and ties in a permutation are broken
by the row's place in its file; an empty table gives an empty result; other columns are not read, so their names cannot
clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, join_hot, located, materialize, whole_rows, with_row_key

BLOCK_TOKENS = 20_000
MOST_BLOCKS = 4096
BYTES_A_TOKEN = 8
TARGET_ENTROPY = 0.9
MAX_EPOCHS = 2.0


def solve_exponent(shares: DataFrame, target_entropy: float, max_epochs: float, passes: float | None = None) -> tuple[float, float]:
    """(exponent, normaliser Z) for the shares in column p (rows with p > 0): the largest exponent whose entropy is at
    least target_entropy * log(number of sources), or the least one that keeps the repetition limit if that is larger.

    ``passes`` is the budget in passes over all sources; without it the largest source is passed over once."""
    n, low, high = shares.agg(F.count("*"), F.min("p"), F.max("p")).first()

    def at(grid: list[float]) -> list[tuple[float, float]]:
        cells = [c for k, a in enumerate(grid) for c in (F.sum(F.pow("p", F.lit(a))).alias(f"z{k}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"s{k}"))]
        row = shares.agg(*cells).first()
        return [(row[f"z{k}"], row[f"s{k}"]) for k in range(len(grid))]

    def section(good: Callable[[float, float, float], bool]) -> tuple[float, float]:
        """The last exponent for which good(a, z, s) holds and the next one that was tried; good holds up to some point."""
        lo, hi = 0.0, 1.0
        for _ in range(5):
            grid = [lo + (hi - lo) * k / 16 for k in range(17)]
            last = max((k for k, (a, (z, s)) in enumerate(zip(grid, at(grid), strict=True)) if good(a, z, s)), default=0)
            lo, hi = grid[last], grid[min(16, last + 1)]
        return lo, hi

    goal = target_entropy * math.log(n)
    a, _ = section(lambda a, z, s: math.log(z) - a * s / z >= goal - 1e-12)  # entropy falls as the exponent grows
    if passes is None:
        least = 0.0 if high <= low else max(0.0, 1 - math.log(max(max_epochs, 1.0)) / math.log(high / low))
    else:  # the smallest source is passed over passes * low^(a - 1) / z times, the fewer the larger the exponent
        over = lambda a, z, s: math.log(passes) + (a - 1) * math.log(low) - math.log(z) > math.log(max_epochs) + 1e-12
        z, s = at([0.0])[0]
        least = section(over)[1] if over(0.0, z, s) else 0.0
    a = max(a, least)
    return a, at([a])[0][0]


def mix(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, budget_tokens: int | None = None, seed: int = 42, block_tokens: int = BLOCK_TOKENS,
        most_blocks: int = MOST_BLOCKS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_tokens: Column | None = None) -> DataFrame:
    """One row per copy of a document in the mixture: doc_id, locator, source, n_tokens, weight, epoch, block, block_rank."""
    if n_tokens is None:
        text = F.col(text_col)
        n_tokens = F.coalesce(F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.ceil(F.octet_length(text) / BYTES_A_TOKEN)), F.lit(0))
    slim = with_row_key(located(docs), doc_id=F.col(id_col).cast("long"), source=F.col(source_col), n_tokens=F.greatest(F.lit(1), n_tokens).cast("long"))
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    slim = materialize(slim.select("doc_id", *ROW, "source", key.alias("key"), "n_tokens"))

    sources = materialize(slim.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    total, largest, rows = sources.agg(F.sum("tokens"), F.max("tokens"), F.sum("n")).first()
    if not total:
        return slim.select("doc_id", *ROW, "source", "n_tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("block_rank"))
    shares = sources.withColumn("p", F.col("tokens") / F.lit(float(total)))
    a, z = solve_exponent(shares, target_entropy, max_epochs, None if budget_tokens is None else max(1, budget_tokens) / total)
    weight = F.pow("p", F.lit(a)) / F.lit(z)
    budget = float(budget_tokens) if budget_tokens is not None else total * z * (largest / total) ** (1 - a)
    least = F.lit(0) if budget_tokens is not None else F.col("tokens")  # without a budget nothing is lost
    quota = F.greatest(least, F.least(F.round(F.col("weight") * budget), F.floor(F.col("tokens") * max_epochs)))
    plan = (
        shares.withColumn("weight", weight)
        .withColumn("blocks", F.least(F.lit(most_blocks), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens))).cast("long"))
        .withColumn("quota", quota.cast("long"))
        .withColumn("passes", F.floor(F.col("quota") / F.col("tokens")))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
        .select("key", "n", "weight", "blocks", "passes", "rest")
    )

    who = F.coalesce("doc_id", ROW[1])  # the same documents give the same mixture, wherever their rows lie
    dealt = join_hot(slim, plan.select("key", "n", "blocks", "weight"), ["key"], "n", rows).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), who), "blocks")).drop("blocks", "n")
    dealt = materialize(dealt)
    blocks = dealt.groupBy("key", "block").agg(F.sum("n_tokens").alias("size")).join(plan.select("key", "passes", "rest"), "key")
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    order = Window.partitionBy("key", "epoch").orderBy(F.xxhash64(F.lit(seed), "key", "epoch", "block"), "block")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.when(F.col("epoch") < F.col("passes"), F.col("size")).otherwise(F.least(F.col("size"), F.col("rest") - before))
    taken = blocks.withColumn("block_rank", F.row_number().over(order)).withColumn("left", left).where("left > 0")
    taken = materialize(taken.select("key", "block", "epoch", "block_rank", "size", "left"))

    columns = ["doc_id", *ROW, "source", "n_tokens", "weight", "epoch", "block", "block_rank"]
    whole = dealt.join(taken.where("left = size"), ["key", "block"]).select(columns)
    edge = dealt.join(taken.where("left < size"), ["key", "block"])
    inside = Window.partitionBy("key", "block", "epoch").orderBy(F.xxhash64(F.lit(seed + 1), who), *ROW).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("before < left").select(columns)
    return whole.unionByName(edge)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` in the mixture's proportions: a document appears once per copy; all its columns stay."""
    docs = located(docs)
    return whole_rows(docs).join(mix(docs, **how).select(*ROW), list(ROW)).select("whole.*")
