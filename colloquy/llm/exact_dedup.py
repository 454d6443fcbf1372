"""Exact duplicates by digest, with the heavy hitters split off (DataFrame functions only).

A Misra-Gries sketch (Spark's approx_top_k, a frequent-items sketch of that family) finds the digests that
could have 1/HEAVY of all rows; their exact winners and sizes are counted with map-side partial sums
and broadcast, so their rows are resolved where they are read. All other digests take one ordinary shuffle,
in which no group can hold more than about 1/HEAVY of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, ascii_lower, id_key, saved, text_of, without

#: Items that the sketch tracks. An item with more than 1/(0.75 * TRACKED) of the rows cannot be missed.
TRACKED = 8192


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 in hex of the text with A-Z lower-cased; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("id"), F.sha2(ascii_lower(text_of(text_col)).cast("binary"), 256).alias("digest"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row.

    Of rows with equal digests the one with the largest id stays. Null texts and empty texts are one group.
    Ids that repeat with an equal text are copies of each other: just one such row is kept. A null id ranks
    below all others and is kept if its group has only null ids. An empty table gives an empty result; other
    columns of docs are not read, so their names cannot clash.
    """
    d = saved(digests(docs, id_col, text_col), "digests")
    top = d.agg(F.expr(f"approx_top_k(digest, {HEAVY}, {TRACKED})").alias("t")).select(F.explode("t").alias("t")).select(F.col("t.item").alias("digest"))
    seen = d.join(F.broadcast(top), "digest").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    # verified: only what really has 2 rows or more and 1/(4 * HEAVY) of all is worth a place in the broadcast
    heavy = saved(seen.where(f"group_size > 1 and group_size * {4 * HEAVY} >= {d.count()}"), "heavy")
    hit = d.join(F.broadcast(heavy), "digest", "left")
    # equal rows of a winner: each has a number of its own, written down, and the smallest stays
    at_top = saved(hit.where("group_size is not null and id <=> keep_id").withColumn("row", F.monotonically_increasing_id()), "winners")
    stays = at_top.groupBy(F.col("digest").alias("d")).agg(F.min("row").alias("stays"))  # one for each heavy digest
    first = at_top.join(F.broadcast(stays), F.col("digest") == F.col("d")).select("id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), "digest")
    lower = hit.where("group_size is not null and not (id <=> keep_id)").select("id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest")
    w = Window.partitionBy("digest")
    rest = (
        hit.where("group_size is null")
        .select("id", "digest", F.max("id").over(w).alias("keep_id"), F.count("*").over(w).alias("group_size"), (F.row_number().over(w.orderBy(F.col("id").desc_nulls_last())) == 1).alias("kept"))
        .select("id", "keep_id", "group_size", "kept", "digest")
    )
    return rest.unionByName(lower).unionByName(first)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies that exact_groups() drops; all columns stay as they are."""
    several = exact_groups(docs, id_col, text_col).where("group_size > 1")
    told = several.groupBy(id_key("id").alias("__id"), F.col("digest").alias("__node")).agg(F.min(~F.col("id").eqNullSafe(F.col("keep_id"))).alias("__goes"))
    return without(docs, told, id_col, F.sha2(ascii_lower(text_of(text_col)).cast("binary"), 256))
