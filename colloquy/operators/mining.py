"""Term associations mined from titles by positive pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def associations(titles: DataFrame, least_df: int = 20, most_share: float = 0.05, least_pairs: int = 8, per_term: int = 12, most_terms: int = 40) -> DataFrame:
    """(term, other, ppmi, rnk) from titles(doc, title).

    A title gives its distinct content words of over two letters; the vocabulary are those in least_df titles and no
    more than most_share of them; titles with 2 to most_terms such words give pairs. T, the mass that counts
    are divided by, is the sum of the vocabulary's document frequencies.
    """
    words = titles.select("doc", F.array_distinct(T.content(T.tokens(F.col("title")), 3)).alias("toks"))
    n = words.agg(F.count("*").alias("n"))
    df = words.select(F.explode("toks").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    vocabulary = df.join(F.broadcast(n), F.lit(True)).where((F.col("df") >= least_df) & (F.col("df") <= F.col("n") * F.lit(most_share))).select("term", "df")
    mass = vocabulary.agg(F.sum("df").cast("double").alias("t"))
    kept = words.select("doc", F.explode("toks").alias("term")).join(vocabulary.select("term"), "term").groupBy("doc").agg(F.sort_array(F.collect_list("term")).alias("toks")).where(F.size("toks").between(2, most_terms))
    # pairs are made inside a title of at most most_terms words, before anything is shuffled
    pairs = kept.select(F.explode(F.flatten(F.transform("toks", lambda a: F.transform(F.filter("toks", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("c")).where(F.col("c") >= least_pairs)
    both = counts.select(F.col("a").alias("term"), F.col("b").alias("other"), "c").unionByName(counts.select(F.col("b").alias("term"), F.col("a").alias("other"), "c"))
    with_df = both.join(vocabulary, "term").join(vocabulary.select(F.col("term").alias("other"), F.col("df").alias("other_df")), "other").join(F.broadcast(mass), F.lit(True))
    ppmi = F.log(F.col("c") * F.col("t") / (F.col("df") * F.col("other_df")))
    positive = with_df.withColumn("ppmi", ppmi).where(F.round("ppmi", 9) > 0)
    order = Window.partitionBy("term").orderBy(F.round("ppmi", 9).desc(), F.col("other").desc())
    return positive.withColumn("rnk", F.row_number().over(order).cast("long")).where(F.col("rnk") <= per_term).select("term", "other", F.round("ppmi", 3).alias("ppmi"), "rnk")
