"""Probes: guards that a generated conversation has to pass, and sheets on which people judge a sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues
from ..functions import text as T
from . import evaluate

#: Bounds of a probe: turns, words of a turn, likeness of neighbouring turns, share of its content words that the product has, words that may not be lifted from its title in a row.
TURNS, WORDS, RESTATED, OVERLAP, LIFTED = (2, 6), (2, 30), 0.7, (0.05, 0.6), 4
NEGATIONS = cues.spoken((*cues.NOT_THIS, "never", "without", "no", "nothing with", "avoid"))
AXES = ("phrasing", "target_ok", "tag_ok")


def refusal(turns: Column, style: Column, title: Column, product: Column) -> Column:
    """Why a probe is refused, the first reason of these, or null: unparseable, turn_count, turn_length, restates, no_negation, copied, off_target, title_ngram.

    turns is an array of texts (null if the reply could not be read), title and product are the product's texts. A null style or product text
    counts as empty.
    """
    said = F.coalesce(turns, F.array().cast("array<string>"))
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    toks = F.transform(said, T.tokens)
    alike = F.zip_with(F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0))), F.slice(toks, 2, F.greatest(F.size(toks), F.lit(1))), T.jaccard)
    content = T.content(F.flatten(toks), 3)
    share = T.overlap(content, T.tokens(F.coalesce(product, F.lit(""))))
    lifted = F.arrays_overlap(T.ngrams(T.tokens(F.coalesce(title, F.lit(""))), LIFTED), F.flatten(F.transform(toks, lambda t: T.ngrams(t, LIFTED))))
    return (
        F.when(turns.isNull(), "unparseable").when(~F.size(said).between(*TURNS), "turn_count")
        .when(F.exists(said, lambda t: ~words(t).between(*WORDS)), "turn_length").when(F.exists(alike, lambda x: x > F.lit(RESTATED)), "restates")
        .when((F.coalesce(style, F.lit("")) == "negation") & ~F.exists(said, lambda t: t.rlike(NEGATIONS)), "no_negation")
        .when(share > F.lit(OVERLAP[1]), "copied").when(share < F.lit(OVERLAP[0]), "off_target").when(lifted, "title_ngram")
    )


def guarded(probes: DataFrame) -> DataFrame:
    """probes(…, turns, style, title, product) with their overlap (3 places) and reason; accepted ones have no reason."""
    toks = F.flatten(F.transform(F.coalesce("turns", F.array().cast("array<string>")), T.tokens))
    share = T.overlap(T.content(toks, 3), T.tokens(F.coalesce("product", F.lit(""))))
    return probes.withColumn("overlap", F.round(share, 3)).withColumn("reason", refusal(F.col("turns"), F.col("style"), F.col("title"), F.col("product")))


def report(judged: DataFrame) -> DataFrame:
    """(reason, n, tokens, median_latency) of judged(reason, tokens, latency): how many probes each reason took, and what the calls cost; reason 'ok' is what passed."""
    return judged.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.percentile("latency", F.lit(0.5)).alias("median_latency"))


def sheet(probes: DataFrame, products: DataFrame, take: int, seed: int = 7, chars: int = 400) -> DataFrame:
    """A sheet of probes(id, tag, turns, target) to be judged by people, drawn in turns from the tags, take in all (the feature's own limit).

    It shows the product's title and the first chars of its text, nothing of how the agent did, and has an empty cell for each axis and a note.
    """
    mixed = F.xxhash64(F.lit(seed), "id")
    deep = probes.withColumn("depth", F.row_number().over(Window.partitionBy("tag").orderBy(mixed, "id")))
    drawn = deep.orderBy("depth", mixed, "id").limit(take).drop("depth")
    shown = products.select(F.col("doc").alias("target"), F.col("title").alias("target_title"), F.substring("text", 1, chars).alias("target_text"))
    return drawn.join(shown, "target", "left").select("id", "tag", "turns", "target", "target_title", "target_text", *[F.lit("").alias(a) for a in AXES], F.lit("").alias("note"))


def agreement(judged: DataFrame) -> DataFrame:
    """(axis, agreed, judged, rate, lo, hi) of a filled sheet(phrasing, target_ok, tag_ok): for each axis the cells that begin with y among those that are filled, with Wilson's interval.

    The axis 'all' counts the probes of which every axis is filled, and agreed on all. Rates of nothing are 0.
    """
    cell = {a: F.lower(F.trim(F.coalesce(F.col(a), F.lit("")))) for a in AXES}
    yes, filled = {a: F.startswith(c, F.lit("y")) for a, c in cell.items()}, {a: c != "" for a, c in cell.items()}
    yes["all"], filled["all"] = yes[AXES[0]] & yes[AXES[1]] & yes[AXES[2]], filled[AXES[0]] & filled[AXES[1]] & filled[AXES[2]]
    one = judged.agg(*[F.count_if(filled[a] & yes[a]).alias(f"k_{a}") for a in yes], *[F.count_if(filled[a]).alias(f"n_{a}") for a in yes])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"k_{a}").alias("agreed"), F.col(f"n_{a}").alias("judged")) for a in yes])).alias("r")).select("r.*")
    low, high = evaluate.wilson(F.col("agreed"), F.col("judged"))
    rate = F.when(F.col("judged") > 0, F.col("agreed") / F.col("judged")).otherwise(F.lit(0.0))
    return rows.select("axis", "agreed", "judged", F.round(rate, 6).alias("rate"), F.round(low, 6).alias("lo"), F.round(high, 6).alias("hi"))
