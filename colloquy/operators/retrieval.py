"""Ranked retrieval. Queries are rows: every operator ranks all of them in one job and breaks ties by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import materialized
from . import blocks
from .index import Index, alikes, term_stats

K1, B, DF_RATIO = 1.5, 0.75, 0.35


def top(scored: DataFrame, k: int, score: str = "score", by: str = "qid") -> DataFrame:
    """The k best rows of each query with their rank rnk: by score to 9 places, then document."""
    w = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), F.col("doc"))
    return scored.withColumn("rnk", F.row_number().over(w).cast("long")).where(F.col("rnk") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, weight 1) of queries(qid, text): distinct tokens."""
    return queries.select("qid", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).withColumn("weight", F.lit(1.0))


def expanded(asked: DataFrame, index_same: DataFrame | None, ranked: DataFrame, k: int) -> DataFrame:
    """(qid, doc, score, rnk): the k best of packed queries and documents, for all queries of the same terms and all documents of the same text."""
    if index_same is not None:
        # of the documents that share a text only the k smallest can be among the k best
        order = Window.partitionBy("first").orderBy("doc")
        few = index_same.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
        ranked = top(top(ranked, k).drop("rnk").withColumnRenamed("doc", "first").join(few, "first").drop("first"), k)
    else:
        ranked = top(ranked, k)
    return asked.join(ranked.withColumnRenamed("qid", "rep"), "rep").select("qid", "doc", "score", "rnk")


def best_terms(terms: DataFrame, index: Index, k: int = 10, k1: float = K1, b: float = B, ratio: float = DF_RATIO) -> DataFrame:
    """(qid, doc, score, rnk): the k best documents by weighted terms(qid, term, weight): BM25 without the factor k1 + 1.

    Terms in more than ratio of the documents and weights of 0 or less are left out before anything is joined.
    """
    size = F.broadcast(index.size)
    useful = terms.where("weight > 0").join(index.terms, "term").join(size, F.lit(True)).where(F.col("df") <= F.col("n") * F.lit(ratio))
    asked, same = blocks.pack_queries(useful.select("qid", "term", (F.col("weight") * F.col("idf")).alias("w")))
    share = lambda tf, dl, avgdl: tf / (tf + k1 * ((1 - b) + b * dl / avgdl))
    ranked = blocks.best(asked, index.packed.join(F.broadcast(index.size.select("avgdl")), F.lit(True)), k, share)
    return expanded(same, index.same, ranked, k)


def bm25(queries: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """(qid, doc, score, rnk): the k best documents of each query text."""
    return best_terms(query_terms(queries), index, k)


def rm3_terms(queries: DataFrame, index: Index, docs: int = 10, words: int = 20, alpha: float = 0.4, ratio: float = DF_RATIO) -> DataFrame:
    """(qid, term, weight): query terms at 1 - alpha and terms of the best documents at up to alpha.

    Each feedback document gives its share of the score, spread over its tokens; stop words, query terms and
    terms in too many documents are left out, and the best words stay.
    """
    original = query_terms(queries)
    best = materialized(bm25(queries, index, docs), "feedback")
    mass = best.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy("qid")))
    grown = mass.join(index.postings_of(best), "doc").groupBy("qid", "term").agg(F.sum(F.col("share") * F.col("tf") / F.col("dl")).alias("w"))
    grown = grown.where(~F.col("term").isin(*T.STOP)).join(original.select("qid", "term"), ["qid", "term"], "left_anti")
    grown = grown.join(index.terms.select("term", "df"), "term").join(F.broadcast(index.size), F.lit(True)).where(F.col("df") <= F.col("n") * F.lit(ratio))
    order = Window.partitionBy("qid").orderBy(F.round("w", 12).desc(), "term")
    kept = grown.withColumn("r", F.row_number().over(order)).where(F.col("r") <= words)
    peak = F.max("w").over(Window.partitionBy("qid"))
    return original.select("qid", "term", F.lit(1 - alpha).alias("weight")).unionByName(kept.select("qid", "term", (F.lit(alpha) * F.col("w") / peak).alias("weight")))


def rm3(queries: DataFrame, index: Index, k: int = 10, **knobs) -> DataFrame:
    """Pseudo-relevance feedback: BM25 again with the terms of its own best documents."""
    return best_terms(rm3_terms(queries, index, **knobs), index, k)


def associated_terms(queries: DataFrame, neighbours: DataFrame, per_term: int = 4, cap: float = 0.35) -> DataFrame:
    """(qid, term, weight): query terms at 1 and their closest neighbours(term, other, ppmi, rnk) at up to cap."""
    original = query_terms(queries)
    near = original.join(neighbours.where(F.col("rnk") <= per_term), "term")
    peak = F.max("ppmi").over(Window.partitionBy("qid"))
    near = near.join(original.select("qid", F.col("term").alias("other")), ["qid", "other"], "left_anti")
    grown = near.withColumn("w", F.lit(cap) * F.col("ppmi") / peak).groupBy("qid", F.col("other").alias("term")).agg(F.max("w").alias("weight"))
    return original.unionByName(grown)


#: Vectors and queries of a block of the search; blocks of queries are broadcast up to so many.
VECTORS, QUERIES, BROADCAST_BLOCKS = 8192, 1024, 64


def vector_blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(ids, data) of rows(key, vector): up to size vectors of a task as one row, eight bytes a number. Rows without a vector are left out."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        data: list[bytes] = []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([ids]), pa.array([b"".join(data)], pa.binary())], names=["ids", "data"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                data.append(v.values.to_numpy(zero_copy_only=False).astype("<f8").tobytes())
                if len(ids) == size:
                    yield out()
                    ids, data = [], []
        if ids:
            yield out()

    return rows.where("vector is not null").select(key, F.col("vector").cast("array<double>")).mapInArrow(run, f"ids array<{kind}>, data binary")


def cosine(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(qid, doc, score, rnk): exact search of unit vectors(doc, vector) for a stated set of queries(qid, vector).

    Blocks of queries meet blocks of vectors in a matrix product, and a pair of blocks gives the k best of each query.
    Query blocks are counted first: few are broadcast, more are shuffled to the blocks of vectors. Vectors have one length.
    """
    asked = materialized(vector_blocks(queries, "qid", QUERIES), "queries").select(F.col("ids").alias("qids"), F.col("data").alias("asked"))
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_BLOCKS else asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qids, a, ids, b in zip(*(batch.column(c) for c in ("qids", "asked", "ids", "data"))):
                score = np.frombuffer(a.as_py()).reshape(len(qids), -1) @ np.frombuffer(b.as_py()).reshape(len(ids), -1).T
                # ties at 9 places are for the last step to break, so all of the k-th score go on
                least = np.sort(np.round(score, 9), axis=1)[:, -min(k, len(ids))]
                q, d = np.nonzero(np.round(score, 9) >= least[:, None])
                yield pa.record_batch([qids.values.take(pa.array(q)), ids.values.take(pa.array(d)), pa.array(score[q, d])], names=["qid", "doc", "score"])

    names = ", ".join(f"{n} {t.schema[n].dataType.simpleString()}" for n, t in (("qid", queries), ("doc", vectors)))
    pairs = vector_blocks(vectors, "doc", VECTORS).crossJoin(asked)  # of blocks
    return top(pairs.mapInArrow(run, f"{names}, score double"), k)


def reciprocal_rank_fusion(rankings: list[tuple[DataFrame, float]], k: int = 10, damping: int = 60) -> DataFrame:
    """(qid, doc, score, rnk) of rankings(qid, doc, rnk) with weights: the sum of weight / (damping + rank)."""
    parts = [r.select("qid", "doc", (F.lit(w) / (F.lit(damping) + F.col("rnk"))).alias("points")) for r, w in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return top(every.groupBy("qid", "doc").agg(F.sum("points").alias("score")), k)


def fielded_bm25(queries: DataFrame, fields: list[tuple[DataFrame, float]], k: int = 10, most_terms: int = 40) -> DataFrame:
    """(qid, doc, score, rnk): BM25 over a weighted frequency that sums fields(doc, text) times their boosts.

    Letters count without their marks. Query terms are the first most_terms distinct tokens of more than one character that are no stop words.
    """
    boosted = lambda w: lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w"))
    parts = [f.select("doc", F.transform(T.tokens(T.folded(F.col("text"))), boosted(w)).alias("bag")) for f, w in fields]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    bags = every.groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list("bag"))).alias("bag")).where(F.size("bag") > 0)
    rows, same = alikes(bags, "bag")
    packed = materialized(blocks.pack(rows.select("doc", "copies", F.col("bag.term").alias("toks"), F.col("bag.w").alias("x"))), "packed")
    size = materialized(packed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("mass") / F.sum("n")).alias("avgdl")), "size")
    df = blocks.frequencies(packed).groupBy("term").agg(F.sum("df").alias("df"))
    terms = queries.select("qid", F.explode(F.slice(F.array_distinct(T.content(T.tokens(T.folded(F.col("text"))), 2)), 1, most_terms)).alias("term")).withColumn("weight", F.lit(1.0))
    return best_terms(terms, Index(None, None, materialized(term_stats(df, size), "terms"), size, packed, None, same), k, k1=1.2, ratio=1.0)


def bm25f(slots: DataFrame, fields: DataFrame, terms: DataFrame, averages: DataFrame, boosts: dict[str, float], k: int = 10, k1: float = 1.2, b: float = 0.6) -> DataFrame:
    """(qid, doc, score, rnk), the k best: per slot(qid, slot, term) the boosted, length-normalized frequencies over fields(doc, field, term, tf, dl), over the slot's idf.

    Documents whose fields say the same of the slots' terms are scored once, and so are queries of the same slots.
    """
    boost: Column = F.create_map(*[F.lit(x) for kv in boosts.items() for x in (kv[0], float(kv[1]))])
    soft = F.col("tf") * boost[F.col("field")] / (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.greatest(F.col("avg_dl"), F.lit(1.0)))
    known = slots.distinct().join(terms, "term")
    total = known.groupBy("qid", "slot").agg(F.sum("idf").alias("idf_total"))
    asked, asks = blocks.pack_queries(known.join(total, ["qid", "slot"]).select("qid", "term", (F.col("idf") / F.col("idf_total")).alias("w")))
    own = fields.join(slots.select("term").distinct(), "term", "left_semi").join(F.broadcast(averages), "field").select("doc", F.struct("term", "field", soft.alias("x")).alias("p"))
    rows, same = alikes(own.groupBy("doc").agg(F.array_sort(F.collect_list("p")).alias("bag")), "bag")
    packed = materialized(blocks.pack(rows.select("doc", "copies", F.col("bag.term").alias("toks"), F.col("bag.x").alias("x"))), "packed")
    ranked = blocks.best(asked, packed.withColumn("avgdl", F.lit(1.0)), k, lambda x, dl, avgdl: x / (x + k1))
    return expanded(asks, same, ranked, k)
