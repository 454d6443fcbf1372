"""Toxicity of whole texts by subword-bag embeddings averaged into a linear softmax.

The text is read in windows of WORDS words (up to twice as many at its end), each word counted once in a window; each
window's mean embedding goes through the softmax, and the text's score is that of its worst window, so a few words in a
long text are not averaged away, and a word that is repeated all over does not add up; windows with fewer than LEAST n-grams
are averaged as if they had so many. Training knows labels of whole texts
only: it starts from random windows and goes on with the windows that the model so far finds worst in each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import subword
from .common import crc_mod, give_back, if_few, saved, small_batches, text_of

WORDS, WORST, LEAST, BITS, SIZES, WIDTH, ROUNDS, WARM, RATE, BATCH = 3, 3, 12, 18, (3, 4, 5, 6, 7), 8, 12, 3, 0.25, 256
#: Bounds of the sample that training sees: rows of each label and of all, and bytes of one text and of all.
ROWS_PER_LABEL, SAMPLE_ROWS, TEXT_BYTES, SAMPLE_BYTES = 2000, 1 << 17, 200_000, 32 << 20
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7


def sample_rows(rows: DataFrame, per_label: int) -> list[tuple[bytes, object]]:
    """A bounded, repeatable sample (text, label) of rows(id, text, label): for each label those of the smallest hashes of id and text.

    Every label has per_label rows at most, all labels together SAMPLE_ROWS, and their texts SAMPLE_BYTES; the first of every
    label go before the second ones. Texts of over TEXT_BYTES are left out of the sample. Equal rows count once, and rows that
    have one id and text but several labels are not learned from. Rows without a label are none.
    """
    own = rows.where(F.col("label").isNotNull()).withColumn("n", F.octet_length("text")).where(F.col("n") <= TEXT_BYTES)
    own = own.select("text", "label", "n", F.xxhash64("id", "text").alias("h"))
    sizes = rows.where(F.col("label").isNotNull()).groupBy(F.col("label").alias("__label")).agg(F.count("*").alias("size"))
    per_label = max(1, min(per_label, SAMPLE_ROWS // max(sizes.count(), 1)))
    # about twice as many hashes as are wanted are looked at, and none of the texts
    near = own.select("label", "n", "h").join(sizes, F.col("label") == F.col("__label"))
    near = near.where(F.pmod("h", F.lit(1 << 30)) < F.lit(1 << 30) * F.lit(2.0 * per_label + 20) / F.col("size"))
    one = near.groupBy("h").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.min("n").alias("n")).where("label = other")
    place: dict[object, int] = {}
    ranked = []
    for r in sorted(one.select("h", "label", "n").collect(), key=lambda r: (r.h % (1 << 30), r.h)):  # 2 * SAMPLE_ROWS and 20 for each label, about
        place[r.label] = place.get(r.label, 0) + 1
        if place[r.label] <= per_label:
            ranked.append((place[r.label], r.h, r.n))
    chosen, total = [], 0
    for _, h, n in sorted(ranked):
        if (total := total + n) > SAMPLE_BYTES:
            break
        chosen.append((h,))
    if not chosen:
        return []
    few = rows.sparkSession.createDataFrame(chosen, "wanted long")  # SAMPLE_ROWS at most
    got = own.join(F.broadcast(few), F.col("h") == F.col("wanted")).groupBy("h").agg(F.any_value("text").alias("text"), F.any_value("label").alias("label"))
    return sorted((r.text.encode("utf-8", "replace"), r.label) for r in got.select("text", "label").toLocalIterator())


def train(sample: list[tuple[bytes, int]], seed: int = 5) -> subword.Model:
    """A model from (text, label 0 or 1). Without both labels it scores every text alike: the share of label 1, or 0."""
    texts, y = [t for t, _ in sample], np.array([int(v) for _, v in sample], np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return subword.Model(np.zeros((2, 2)), np.array([0.0, 40.0 if share else -40.0]), [0, 1], 1)
    # every fifth text is kept from training, to fit the heat of the scores
    test, fit_on = [i for i in range(len(texts)) if i % 5 == 4], [i for i in range(len(texts)) if i % 5 < 4]
    unseen, texts, y_test, y = [texts[i] for i in test], [texts[i] for i in fit_on], y[test], y[fit_on]
    t = subword.Trainer([0, 1], BITS, WIDTH, SIZES, seed, RATE, LEAST)
    parts = []
    for first, held in subword.chunks(texts):
        low, starts = subword.clean(held)
        begins, of = subword.windows(low, starts, WORDS)
        parts.append((first, low, begins, of, subword.repeats(low, begins)))
    for k in range(ROUNDS):
        model, bags, ys = t.model(), [], []
        for first, low, begins, of, skip in parts:
            if k < WARM:
                worth = t.rng.random(len(begins))
            else:
                x = subword.window_logits(model, low, begins, skip)
                worth = x[:, 1] - x[:, 0]
            order = np.lexsort((-worth, of))
            rank = np.arange(len(of)) - np.searchsorted(of[order], of[order])
            label = y[first + of[order]]
            chosen = np.sort(order[(rank < 2) | ((rank < 3) & (label == 0)) | ((k < WARM) & (rank < 4))])
            bags += subword.window_bags(low, begins, t.sizes, t.bits, chosen, skip)
            ys.append(y[first + of[chosen]])
        nothing = max(8, len(bags) // 10)  # windows without n-grams are clean
        bags += [np.zeros(0, np.int64)] * nothing
        ys = np.concatenate([*ys, np.zeros(nothing, np.int64)])
        weight = np.where(ys == 1, 0.5 / max((ys == 1).sum(), 1), 0.5 / max((ys == 0).sum(), 1)) * len(ys)
        for i in np.array_split(t.rng.permutation(len(bags)), -(-len(bags) // BATCH)):
            t.step([bags[j] for j in i], ys[i], weight[i])
    model = t.model()
    for x in (model.table, model.bias):  # only the difference counts
        x[..., 1] -= x[..., 0]
        x[..., 0] = 0
    if len(set(y_test.tolist())) == 2:
        slope, model.shift = subword.fit_odds(log_odds(model, unseen), y_test)
        model.heat = 1 / slope
    return model


def log_odds(model: subword.Model, texts: list[bytes]) -> np.ndarray:
    """For each text the mean log-odds of label 1 in its WORST worst windows (in all, if it has fewer)."""
    out = np.zeros(len(texts))
    for first, held in subword.chunks(texts):
        low, starts = subword.clean(held)
        begins, of = subword.windows(low, starts, WORDS)
        x = subword.window_logits(model, low, begins, subword.repeats(low, begins))
        z = x[:, 1] - x[:, 0]
        order = np.lexsort((-z, of))
        rank = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        top = order[rank < WORST]
        out[first : first + len(held)] = np.bincount(of[top], z[top], len(held)) / np.bincount(of[top], minlength=len(held))
    return out


def scores(model: subword.Model, texts: list[bytes]) -> np.ndarray:
    """For each text the calibrated probability of label 1."""
    return 1 / (1 + np.exp(-np.clip(log_odds(model, texts) + model.shift, -500, 500)))


def score_udf(spark, model: subword.Model):
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(scores(held.value, [t.as_py() or b"" for t in texts.cast(pa.binary())]))
        give_back()

    return score


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> subword.Model:
    """Trains on a bounded sample of labelled rows whose crc32(id) modulo FOLDS isn't HELD_OUT. Labels of other rows are never read.

    An id with labels of both kinds has none. Of ids that have one, those of the smallest hashes are looked up among
    docs, three times as many as the sample has at most, so that ids without a document and equal rows leave enough.
    """
    allowed = labels.where(crc_mod(id_col, FOLDS) != HELD_OUT).where(F.col(label_col).isin(0, 1))
    known = allowed.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other").drop("other")
    known = saved(known, "labels")
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    share = F.when(F.col("label") == 1, F.lit(3.0 * ROWS_PER_LABEL / max(sizes.get(1, 0), 1))).otherwise(F.lit(3.0 * ROWS_PER_LABEL / max(sizes.get(0, 0), 1)))
    few = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < F.lit(1 << 30) * share)
    own = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return train(sample_rows(own.join(if_few(few), F.col("id") == F.col("__id")).select("id", "text", "label"), ROWS_PER_LABEL))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) for every row.

    score is in 0 to 1, higher for label 1; predicted is 1 from THRESHOLD on. Null and empty texts are scored as an
    empty window. A null id is not held out and has no label. Repeated rows are scored each alike. Without labels
    of both kinds the scores say nothing. An empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    score = score_udf(docs.sparkSession, fit(docs, labels, id_col, text_col, label_col))
    out = own.select("id", F.coalesce(crc_mod("id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs without the rows that score THRESHOLD or more; all columns stay as they are."""
    score = score_udf(docs.sparkSession, fit(docs, labels, id_col, text_col, label_col))
    return docs.withColumn("__score", score(F.col(text_col).cast("string"))).where(F.col("__score") < THRESHOLD).drop("__score")
