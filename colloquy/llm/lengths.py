"""Token counts as an exact histogram of encoded lengths.

Documents are counted by encoded length; sums over the histogram then answer totals, quantiles and truncated
totals for every context limit. The running sums are built in two levels (spans of lengths, then lengths
within a span), so no task sees more than a span's lengths or the list of spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import tokens
from .common import give_back, saved, small_batches

SPAN, MEMO = 128, 400_000


def token_count_udf(vocabulary: str):
    """Number of byte-level BPE ids of a whole text, without special tokens; a null text has none."""

    @arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find, encode = tokens.matches(), tokens.encoder(vocabulary)
        size = tokens.Memo(lambda w: len(encode(w.encode("utf-8", "replace"))), MEMO)
        whole = lambda t: sum(size[w] for w in find(t))
        after = tokens.Memo(lambda x: sum(map(size.__getitem__, tokens.words_after_space(x))), MEMO)

        def of(text: str | None) -> int:
            if not text:
                return 0
            if (cut := tokens.pieces(text)) is None:
                return whole(text)
            return whole(cut[0]) + sum(map(after.__getitem__, cut[1]))

        for texts in batches:
            yield pa.array([of(t.as_py()) for t in texts], pa.int64())
        del size, after
        give_back()

    return count


def length_histogram(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length. It is written out, so that texts are encoded once."""
    small_batches(docs.sparkSession)
    sizes = docs.select(token_count_udf(vocabulary)(F.col(text_col).cast("string")).alias("n_tokens"))
    return saved(sizes.groupBy("n_tokens").agg(F.count("*").alias("docs")), "lengths")


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit, what the histogram says.

    Of (n_tokens, docs) it returns: n_tokens; docs; docs_within and tokens_within (documents no longer than
    the limit); docs_beyond and tokens_beyond (longer ones, whole); tokens_truncated (all documents cut to the
    limit); quantile (share of documents within). An empty histogram gives no rows.
    """
    h = histogram.select("n_tokens", "docs", F.floor(F.col("n_tokens") / SPAN).cast("long").alias("span"), (F.col("n_tokens") * F.col("docs")).alias("tokens"))
    spans = h.groupBy("span").agg(F.sum("docs").alias("span_docs"), F.sum("tokens").alias("span_tokens"))
    up = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    run = [F.coalesce(F.sum(f"span_{c}").over(w), F.lit(0)).alias(f"{n}_{c}") for n, w in (("before", up), ("after", down)) for c in ("docs", "tokens")]
    around = spans.select("span", *run)
    within, beyond = (Window.partitionBy("span").orderBy(o).rowsBetween(Window.unboundedPreceding, end) for o, end in ((F.col("n_tokens"), 0), (F.col("n_tokens").desc(), -1)))
    sums = h.join(around, "span").select(
        "n_tokens", "docs",
        *[(F.col(f"before_{c}") + F.sum(c).over(within)).alias(f"{c}_within") for c in ("docs", "tokens")],
        *[(F.col(f"after_{c}") + F.coalesce(F.sum(c).over(beyond), F.lit(0))).alias(f"{c}_beyond") for c in ("docs", "tokens")],
    )
    cut = F.col("tokens_within") + F.col("n_tokens") * F.col("docs_beyond")
    return sums.select("*", cut.alias("tokens_truncated"), (F.col("docs_within") / (F.col("docs_within") + F.col("docs_beyond"))).alias("quantile"))


def length_quantile(limits: DataFrame, q: float) -> DataFrame:
    """One row (n_tokens): the smallest length that a share q of the documents doesn't exceed; null if there are none."""
    return limits.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """One row (docs_truncated, tokens_truncated) for any limit, whether or not a document has that length.

    The longest length within the limit answers it; a limit below all lengths truncates every document.
    """
    below = limits.where(F.col("n_tokens") <= limit).agg(F.max(F.struct("n_tokens", "tokens_within", "docs_beyond")).alias("b"))
    every = limits.agg(F.max(F.col("docs_within") + F.col("docs_beyond")).alias("all_docs"))
    beyond = F.coalesce(F.col("b.docs_beyond"), F.col("all_docs"), F.lit(0))
    return below.join(F.broadcast(every), F.lit(True)).select(beyond.alias("docs_truncated"), (F.coalesce("b.tokens_within", F.lit(0)) + F.lit(limit) * beyond).alias("tokens_truncated"))
