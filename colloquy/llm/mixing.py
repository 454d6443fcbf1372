"""Mixing sources to target weights by a temperature on their token shares (DataFrame functions only).

A source with share p of the tokens gets a weight in proportion to p ** exponent. The exponent is found by repeated
section (32 candidates at once, one small aggregate over the sources a round), either for a target entropy of the
weights or as the flattest mix in which no document is repeated more than a limit. The weights are then
realised within a token budget: whole passes over a source, and for what is left a pass over its blocks in
a permuted order up to the quota; only the one block at the quota's edge is cut by document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, attach, id_key, saved

SECTIONS, ROUNDS, BLOCK_DOCS, MOST_BLOCKS = 32, 6, 1024, 65_536


def word_count(text_col: str) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measure(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy of the weights, most over least repetition) for each exponent; sources(share), shares above 0."""
    grid = sources.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("x"))
    each = grid.groupBy("x").agg(
        F.sum(F.pow("share", F.col("x"))).alias("z"),
        F.sum(F.pow("share", F.col("x")) * F.log("share")).alias("l"),
        (F.max(F.pow("share", F.col("x") - 1)) / F.min(F.pow("share", F.col("x") - 1))).alias("r"),
    )
    got = {r.x: (math.log(r.z) - r.x * r.l / r.z, r.r) for r in each.collect()}  # a row for each of the exponents
    return [got[x] for x in exponents]


def solve_exponent(sources: DataFrame, entropy: float | None = None, repetition: float | None = None) -> float:
    """The exponent in [0, 1] that meets the target; sources(share).

    entropy: that of the weights in nats; the nearest that exponents in [0, 1] reach. repetition: the flattest mix
    in which the most repeated source is passed over at most so many times as often as the least repeated one.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either an entropy or a repetition limit")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        xs = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        # both fall as the exponent grows: take the section where the target is crossed
        over = [(h > entropy) if entropy is not None else (r > repetition * (1 + 1e-12)) for h, r in _measure(sources, xs)]
        i = over.index(False) if False in over else SECTIONS
        if i == 0:
            return low
        low, high = xs[i - 1], xs[i]
    return high


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float | None = None, repetition: float | None = 2.0, budget: int | None = None, seed: int = 17, tokens_col: str | None = None) -> DataFrame:
    """(id, source, n_tokens, weight, copies, block) for every row: how often the mix holds the document.

    Tokens are words between ASCII white space, or what column tokens_col counts (null: none). budget is in tokens; None means the smallest in which every document is held once at least. copies is the number
    of whole passes, and one more if the document lies in the permuted blocks that fill the rest of the
    quota. Documents without words (null, empty or blank texts) take no budget: one copy and block 0. A null
    source is a source of its own. Repeated rows count each and may get different copies only through their
    place in a block. An empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), (word_count(text_col) if tokens_col is None else F.coalesce(F.col(tokens_col).cast("long"), F.lit(0).cast("long"))).alias("n_tokens"))
    rows = saved(own.withColumn("key", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))), "sizes")
    totals = rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    whole = totals.agg(F.sum("tokens").alias("t"), F.sum("n").alias("n")).first()
    n_rows, n_tokens = whole.n or 0, whole.t or 0
    if not n_tokens:
        return rows.select("id", "source", "n_tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("block"))
    sources = saved(totals.withColumn("share", F.col("tokens") / F.lit(float(n_tokens))), "sources")
    real = sources.where("tokens > 0")
    x = solve_exponent(real, entropy, repetition)
    z, most = real.agg(F.sum(F.pow("share", F.lit(x))), F.max(F.pow("share", F.lit(1 - x)))).first()
    # a source is passed over budget * weight / tokens = budget / n_tokens * share ** (x - 1) / z times
    times = (budget / n_tokens / z) if budget is not None else most
    quota = F.col("tokens") * F.lit(times) * F.pow("share", F.lit(x - 1))
    quota = F.when(F.abs(quota - F.round(quota)) < 1e-9 * quota, F.round(quota)).otherwise(quota)
    blocks = F.least(F.greatest(F.floor(F.col("n") / BLOCK_DOCS), F.lit(1)), F.lit(MOST_BLOCKS)).cast("long")
    facts = real.select("key", "n", (F.pow("share", F.lit(x)) / F.lit(z)).alias("weight"), F.floor(quota / F.col("tokens")).cast("long").alias("passes"), (quota - F.floor(quota / F.col("tokens")) * F.col("tokens")).alias("rest"), blocks.alias("blocks"))
    order = F.xxhash64(F.lit(seed), "key", id_key("id"))
    dealt = attach(rows, facts, "key", "n", max(n_rows, 1)).withColumn("order", order).withColumn("block", F.pmod("order", F.coalesce("blocks", F.lit(1))).cast("long"))
    dealt = saved(dealt.select("id", "source", "n_tokens", "key", "weight", "passes", "rest", "order", "block"), "dealt")
    sums = dealt.where("passes is not null").groupBy("key", "block", "rest").agg(F.sum("n_tokens").alias("in_block"))
    permuted = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 1), "key", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("in_block").over(permuted), F.lit(0)))
    placed = placed.select(F.col("key").alias("k"), F.col("block").alias("b"), "before", (F.col("before") + F.col("in_block") <= F.col("rest")).alias("all_in"), ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_block") > F.col("rest"))).alias("edge"))
    out = dealt.join(placed, (F.col("key") == F.col("k")) & (F.col("block") == F.col("b")), "left")
    inside = Window.partitionBy("key", "block").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0)
    columns = lambda extra: ["id", "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), extra.alias("copies"), "block"]
    one = F.lit(1).cast("long")
    plain = out.where("edge is null or not edge").select(*columns(F.when(F.col("passes").isNull() | (F.col("n_tokens") == 0), one).otherwise(F.col("passes") + F.col("all_in").cast("long"))))
    cut = out.where("edge").withColumn("up_to", F.col("before") + F.sum("n_tokens").over(inside))
    cut = cut.select(*columns(F.when(F.col("n_tokens") == 0, one).otherwise(F.col("passes") + (F.col("up_to") <= F.col("rest")).cast("long"))))
    return plain.unionByName(cut)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **plan) -> DataFrame:
    """docs with every row as often as plan_mix() says; all columns stay as they are. Rows with one id get the same number, the largest of theirs."""
    rows = plan_mix(docs, id_col, text_col, source_col, **plan).groupBy(id_key("id").alias("__key")).agg(F.max("copies").alias("__copies"), F.count("*").alias("__rows"))
    # most rows have one copy and need not be told
    copies = saved(rows.where("__copies <> 1").withColumnRenamed("__key", "__id"), "copies")
    total = copies.agg(F.sum("__rows")).first()[0] or 1
    own = docs.withColumn("__key", id_key(id_col))
    if copies.limit(FEW + 1).count() <= FEW:
        held = own.join(F.broadcast(copies), F.col("__key") == F.col("__id"), "left")
    else:
        held = attach(own, copies.withColumnRenamed("__id", "__key"), "__key", "__rows", total)
    held = held.withColumn("__copies", F.coalesce("__copies", F.lit(1).cast("long"))).where("__copies > 0")
    return held.withColumn("__pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
