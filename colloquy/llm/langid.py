"""Language identification by averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Training sees random windows of sampled documents. The softmax's heat and the rejection threshold are then
fitted on sampled rows that training has not seen: a prediction is rejected below the score that keeps ACCEPTED of the
right predictions. Scoring reads each text as one window, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import subword
from .common import crc_mod, give_back, small_batches
from .toxicity import sample_rows

BITS, SIZES, WIDTH, EPOCHS, RATE, BATCH, WORDS = 18, (2, 3, 4), 12, 4, 0.25, 256, 24
#: Bounds of the sample: rows of each language, and windows of a row; toxicity.py has those of all rows and of bytes. Every language is learned.
ROWS_PER_LANG, WINDOWS = 600, 8
FOLDS, HELD_OUT, ACCEPTED, UNKNOWN = 4, 2, 0.995, "und"


@dataclass
class Identifier:
    model: subword.Model
    least: float  # scores below are rejected


def train(sample: list[tuple[bytes, str]], seed: int = 11) -> Identifier | None:
    """Learns from (text, lang); every fifth row is kept for calibration. None without any language."""
    classes = sorted({v for _, v in sample})
    if not classes:
        return None
    y = np.array([classes.index(v) for _, v in sample])
    if len(classes) == 1:
        return Identifier(subword.Model(np.zeros((2, 1)), np.zeros(1), classes, 1, SIZES), 0.0)
    t = subword.Trainer(classes, BITS, WIDTH, SIZES, seed, RATE)
    kept = t.rng.permutation(len(sample))
    test, fit = kept[::5], np.array([i for k, i in enumerate(kept) if k % 5])
    bags: list[np.ndarray] = []
    ys = []
    texts = [sample[i][0] for i in fit]
    for first, held in subword.chunks(texts):
        low, starts = subword.clean(held)
        begins, of = subword.windows(low, starts, WORDS)
        order = np.lexsort((t.rng.random(len(of)), of))
        rank = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        chosen = np.sort(order[rank < WINDOWS])
        bags += subword.window_bags(low, begins, SIZES, BITS, chosen)
        ys.append(y[fit[first + of[chosen]]])
    ys = np.concatenate(ys)
    rows = np.bincount(ys, minlength=len(classes))
    weight = (len(ys) / np.maximum(rows, 1) / len(classes))[ys]
    for _ in range(EPOCHS):
        for i in np.array_split(t.rng.permutation(len(bags)), -(-len(bags) // BATCH)):
            t.step([bags[j] for j in i], ys[i], weight[i])
    model = t.model()
    logits = text_logits(model, [sample[i][0] for i in test])
    model.heat = subword.fit_heat(logits, y[test])
    p = subword.softmax(logits / model.heat)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[test]])
    return Identifier(model, float(right[int((1 - ACCEPTED) * len(right))]) if len(right) else 0.0)


def text_logits(model: subword.Model, texts: list[bytes]) -> np.ndarray:
    out = []
    for _, held in subword.chunks(texts):
        low, starts = subword.clean(held)
        out.append(subword.window_logits(model, low, starts[:-1]))
    return np.concatenate(out) if out else np.zeros((0, len(model.classes)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier | None:
    """Learns from a bounded sample of the rows with a language whose crc32(id) modulo FOLDS isn't HELD_OUT."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where(crc_mod("id", FOLDS) != HELD_OUT).where(F.col("lang").isNotNull())
    return train(sample_rows(own.select("id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("label")), ROWS_PER_LANG))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, accepted) for every row.

    lang_pred is the likeliest learned language of the whole text, score its calibrated probability, and accepted
    says whether the score passes the rejection threshold. Texts that are null or have no letter are UNKNOWN with
    score 0, and so is every text if no language could be learned. A null id is not held out, and isn't learned from.
    Repeated rows are scored each alike. An empty table gives no rows; columns other than these are not read.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))

    @arrow_udf("lang_pred string, score double, accepted boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        who, letter = held.value, regex.compile(r"\p{L}").search
        for texts in batches:
            n = len(texts)
            lang, score, sure = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
            said = [t.as_py() for t in texts]
            on = [i for i, t in enumerate(said) if t and letter(t)] if who else []
            if on:
                p = subword.softmax(text_logits(who.model, [said[i].encode("utf-8", "replace") for i in on]))
                best = p.argmax(axis=1)
                lang[on], score[on] = np.array(who.model.classes, object)[best], p[np.arange(len(on)), best]
                sure[on] = score[on] >= who.least
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(sure)], ["lang_pred", "score", "accepted"])
        give_back()

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = own.select("id", F.coalesce(crc_mod("id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), predict("text").alias("p"))
    return out.select("id", "held_out", "p.lang_pred", "p.score", "p.accepted")
