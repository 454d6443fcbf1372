"""Measuring sessions: rates, ranks, turns, their rollups, intervals, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialized
from .index import FEW

TURNS, MISS, WEIGHTS = 10, 11, (0.5, 0.3, 0.2)


def metrics() -> list[Column]:
    """Aggregates over sessions(hit, reciprocal_rank, first_hit_turn), rounded to 6 places."""
    return [
        F.count("*").alias("sessions"),
        F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.round(F.avg(F.when(F.col("hit"), F.col("first_hit_turn")).otherwise(F.lit(MISS)).cast("double")), 6).alias("mttc"),
    ]


def composite(hit: Column, mrr: Column, mttc: Column) -> Column:
    h, m, t = WEIGHTS
    return F.lit(h) * hit + F.lit(m) * mrr + F.lit(t) * F.least(F.greatest((F.lit(float(MISS)) - mttc) / F.lit(10.0), F.lit(0.0)), F.lit(1.0))


def summary(sessions: DataFrame, by: str | None = None) -> DataFrame:
    """One row of metrics and their composite (from the rounded figures); with by also a row for each value, and null for all."""
    out = (sessions.rollup(by) if by else sessions.groupBy()).agg(*metrics())
    return out.withColumn("composite", F.round(composite(F.col("hit_rate"), F.col("mrr"), F.col("mttc")), 6))


def exact_composite(sessions: DataFrame) -> DataFrame:
    """One row (composite) from figures that are not rounded before; null without sessions."""
    turn = F.when(F.col("hit"), F.col("first_hit_turn")).otherwise(F.lit(MISS)).cast("double")
    return sessions.agg(composite(F.avg(F.col("hit").cast("double")), F.avg("reciprocal_rank"), F.avg(turn)).alias("composite"))


def first_hits(shown: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """(sample_id, hit, first_hit_turn, best_rank, reciprocal_rank) of shown(sample_id, turn, doc, rnk) and targets(sample_id, target): the first turn whose first k have the target."""
    hit = shown.where(F.col("rnk") <= k).join(targets, "sample_id").where(F.col("doc") == F.col("target"))
    first = hit.groupBy("sample_id").agg(F.min(F.struct("turn", "rnk")).alias("f"))
    out = targets.join(first, "sample_id", "left")
    return out.select("sample_id", F.col("f").isNotNull().alias("hit"), F.col("f.turn").alias("first_hit_turn"), F.col("f.rnk").alias("best_rank"), F.coalesce(F.lit(1.0) / F.col("f.rnk"), F.lit(0.0)).alias("reciprocal_rank"))


def valid_recommendations(said: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """(sid, doc, rnk) of said(sid, pos, item): trimmed, in catalog(item), each once at its first place, k at most."""
    rows = said.select("sid", "pos", F.trim("item").alias("item"))
    # what is said is looked up once, and few items are broadcast: a row's item may be that of a large share of all
    items = materialized(rows.select("item").distinct().join(catalog.select("item"), "item", "left_semi"), "items")
    known = rows.join(F.broadcast(items) if items.count() <= FEW else items, "item", "left_semi")
    once = known.groupBy("sid", "item").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("sid").orderBy("pos")
    return once.select("sid", "item", F.row_number().over(order).cast("long").alias("rnk")).where(F.col("rnk") <= k)


def crosstab(rows: DataFrame, runs: list[str]) -> DataFrame:
    """(tag, one column for each run, winner) of rows(tags, run, value): means by tag, and the run with the largest; none if all are equal."""
    wide = rows.select(F.explode("tags").alias("tag"), "run", "value").groupBy("tag").pivot("run", runs).agg(F.round(F.avg("value"), 6))
    most, least = F.greatest(*runs) if len(runs) > 1 else F.col(runs[0]), F.least(*runs) if len(runs) > 1 else F.col(runs[0])
    first = F.coalesce(*[F.when(F.col(r) == most, F.lit(r)) for r in runs])
    return wide.withColumn("winner", F.when(most > least, first))


def draw(i: Column, j: Column, n: Column, seed: int = 1) -> Column:
    """A repeatable pseudo-random index below n for resample i and place j, by whole-number arithmetic that any engine has."""
    x = ((i * F.lit(1103515245) + j * F.lit(12345) + F.lit(seed)) % F.lit(2147483647)).cast("long")
    y = (x * F.lit(48271)) % F.lit(2147483647)
    z = (y * F.lit(69621) + j) % F.lit(2147483647)
    return (z % n).cast("long")


def numbered(rows: DataFrame, by: str, name: str = "idx") -> DataFrame:
    """rows with a number from 0 in the order of column by, without gathering them in one task."""
    ordered = materialized(rows.repartitionByRange(by).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each task
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1
    return ordered.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + place).cast("long")).drop("__part", "__before")


def resamples(values: DataFrame, iterations: int, seed: int = 1) -> DataFrame:
    """(i, means of the columns but idx) over iterations resamples of values(idx from 0, …)."""
    n = values.count()
    if not n:
        return values.select(F.lit(0).cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in values.columns if c != "idx"])
    i, j = F.expr(f"id div {n}"), F.col("id") % n
    drawn = values.sparkSession.range(iterations * n).select(i.alias("i"), draw(i, j, F.lit(n), seed).alias("idx")).join(values, "idx")
    return drawn.groupBy("i").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in values.columns if c != "idx"])


def bootstrap(values: DataFrame, iterations: int = 1000, alpha: float = 0.05) -> DataFrame:
    """One row (mean, lo, hi) of the composite of values(idx, hit, rr, turn) under resampling."""
    r = resamples(values, iterations).select(F.round(composite(F.col("hit"), F.col("rr"), F.col("turn")), 9).alias("s"))
    return r.agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.percentile("s", F.lit(alpha / 2)), 6).alias("lo"), F.round(F.percentile("s", F.lit(1 - alpha / 2)), 6).alias("hi"))


def paired_bootstrap(values: DataFrame, iterations: int = 1000, alpha: float = 0.05) -> DataFrame:
    """One row (delta, lo, hi, p_positive) of the difference b - a of values(idx, a, b); one draw serves both."""
    r = resamples(values, iterations).select(F.round(F.col("b") - F.col("a"), 9).alias("d"))
    return r.agg(F.round(F.avg("d"), 6).alias("delta"), F.round(F.percentile("d", F.lit(alpha / 2)), 6).alias("lo"), F.round(F.percentile("d", F.lit(1 - alpha / 2)), 6).alias("hi"), F.round(F.avg((F.col("d") > 0).cast("double")), 6).alias("p_positive"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The bounds of Wilson's interval for k of n; 0 and 0 without any."""
    p, zz = k / n, F.lit(z * z)
    middle, half = p + zz / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low, high = (middle - half) / (1 + zz / n), (middle + half) / (1 + zz / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(low, F.lit(0.0))), F.when(n == 0, F.lit(0.0)).otherwise(F.least(high, F.lit(1.0)))


def round_robin(rows: DataFrame, stratum: str, key: str, take: int, seed: int = 7) -> DataFrame:
    """A stratified sample of rows: the first of each stratum in a hashed order, then the second, and so on, take in all (the feature's own limit)."""
    mixed = (F.col(key) * F.lit(48271) + F.lit(seed)) % F.lit(2147483647)
    deep = rows.withColumn("mixed", mixed).withColumn("depth", F.row_number().over(Window.partitionBy(stratum).orderBy("mixed", key)).cast("long"))
    return deep.orderBy("depth", "mixed", key).limit(take).drop("mixed")


def prefixes(messages: DataFrame) -> DataFrame:
    """(conv, turn, transcript): all that was said up to each turn of messages(conv, turn, text)."""
    w = Window.partitionBy("conv").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return messages.select("conv", "turn", F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), " ").alias("transcript"))


def mirror(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b, both): how many rows two tables of the same columns share, counted with repeats."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("s")).unionByName(b.select(*columns, F.lit(-1).alias("s"))).groupBy(*columns).agg(F.sum(F.when(F.col("s") > 0, 1).otherwise(0)).alias("x"), F.sum(F.when(F.col("s") < 0, 1).otherwise(0)).alias("y"))
    return both.agg(F.coalesce(F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))), F.lit(0)).alias("only_b"), F.coalesce(F.sum(F.least("x", "y")), F.lit(0)).alias("both"))


def rare_tokens_dropped(toks: DataFrame, share: float) -> DataFrame:
    """(rid, kept): the tokens of toks(rid, pos, term, idf) without the rarest share (one at least, if share is above 0), in order."""
    n = F.count("*").over(Window.partitionBy("rid"))
    drop = F.greatest(F.lit(1), F.round(n * F.lit(share))) if share > 0 else F.lit(0)
    order = Window.partitionBy("rid").orderBy(F.round("idf", 9).desc(), "pos")
    kept = toks.withColumn("r", F.row_number().over(order)).withColumn("drop", drop)
    left = F.filter(F.array_sort(F.collect_list(F.struct("pos", "term", (F.col("r") > F.col("drop")).alias("keep")))), lambda x: x.keep)
    return kept.groupBy("rid").agg(F.array_join(F.transform(left, lambda x: x.term), " ").alias("kept"))


def proportional_sample(rows: DataFrame, stratum: str, key: str, take: int, seed: int = 7) -> DataFrame:
    """Of each stratum its share of take rows (the feature's own limit), rounded, one at least, in a hashed order."""
    mixed = (F.col(key) * F.lit(48271) + F.lit(seed)) % F.lit(2147483647)
    own, every = F.count("*").over(Window.partitionBy(stratum)), rows.agg(F.count("*").alias("all_rows"))
    placed = rows.join(F.broadcast(every), F.lit(True)).withColumn("quota", F.greatest(F.lit(1), F.round(own * take / F.col("all_rows"))))
    placed = placed.withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy(mixed, key)))
    return placed.where(F.col("r") <= F.col("quota")).drop("quota", "r", "all_rows")


def by_turn(messages: DataFrame) -> DataFrame:
    """(qid, conv, turn, text): each prefix of a conversation as a question of its own, for controls that see as much as the agent did."""
    return prefixes(messages).select(F.concat_ws(":", "conv", "turn").alias("qid"), "conv", "turn", F.col("transcript").alias("text"))
