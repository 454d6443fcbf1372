"""Document likelihood by a subword lattice: all segmentations of each word into pieces of a public vocabulary.

The pieces and their scores come from an existing sentencepiece model. Its scores rank the pieces, and a piece's
probability is in proportion to 1 / rank, unless it is fitted to the training words. What is learned from the training documents are the words'
counts, the share of the end among all tokens and, if rounds of fitting are asked for, the pieces' probabilities. A document is its words, each begun by the mark of a word start, and an end;
as no piece goes over a word start, its marginal log-probability is the sum of its words'. Texts are cut into
words with their positions (see words.py); each distinct word is shuffled once for a slice of texts, is counted and
its lattice run once, and its count and score go back to the slices, where each text sums its words'.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import words as W
from .common import crc_mod, give_back, saved

ALPHA, MARK = 0.1, "▁".encode()
#: The share of a fitted piece's weight that stays what its rank gives, so that no piece loses all.
RANKS = 1e-3


def default_pieces() -> str:
    """The path of the public piece model, if its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(model_path: str) -> dict[bytes, float]:
    """Bytes of each piece -> weight 1 / rank, from the model's scores. Byte pieces rank behind all others, so every text has a segmentation. The weights sum to 1."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    rank = {i: k + 1 for k, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
    out: dict[bytes, float] = {}
    for i in plain:
        piece = model.id_to_piece(i).encode()
        if MARK not in piece[1:]:  # runs of word starts cannot occur
            out[piece] = out.get(piece, 0.0) + 1.0 / rank[i]
    for b in range(256):
        out[bytes([b])] = out.get(bytes([b]), 0.0) + 1.0 / (n + b)
    z = sum(out.values())
    return {p: w / z for p, w in out.items()}


class Lattice:
    """Forward sums over all segmentations of a word. weights: piece -> probability."""

    def __init__(self, weights: dict[bytes, float]):
        self.weights = weights
        self.longest = max(map(len, weights))
        # beginnings of pieces that are no pieces have probability 0, so that one look-up says whether to go on
        self.begun = dict.fromkeys((p[:k] for p in weights for k in range(1, len(p))), 0.0) | weights

    def log_probability(self, word: bytes) -> float:
        """The logarithm of the sum over all segmentations; a scale that moves on with the position keeps long words from underflow."""
        n, get, longest = len(word), self.begun.get, self.longest
        alpha, shift = [0.0] * (n + 1), 0.0
        alpha[0] = 1.0
        for i in range(n):
            x = alpha[i]
            if x < 1e-200:
                up = 1.0 / x
                shift -= math.log(up)
                for k in range(i, min(n, i + longest) + 1):
                    alpha[k] *= up
                x = 1.0
            for j in range(i + 1, n + 1):
                p = get(word[i:j])
                if p is None:
                    break
                if p:
                    alpha[j] += x * p
        return math.log(alpha[n]) + shift


    def expected(self, word: bytes, counts: dict[bytes, float]) -> None:
        """Adds to counts how often each piece stands in the word, on average over its segmentations by their probability."""
        n, get, longest = len(word), self.begun.get, self.longest
        alpha, at, shift, edges = [0.0] * (n + 1), [0.0] * (n + 1), 0.0, []
        alpha[0] = 1.0
        for i in range(n):
            x = alpha[i]
            at[i] = math.log(x) + shift
            if x < 1e-200:
                up = 1.0 / x
                shift -= math.log(up)
                for k in range(i, min(n, i + longest) + 1):
                    alpha[k] *= up
                x = 1.0
            for j in range(i + 1, n + 1):
                piece = word[i:j]
                p = get(piece)
                if p is None:
                    break
                if p:
                    alpha[j] += x * p
                    edges.append((j, i, piece, p))
        at[n] = math.log(alpha[n]) + shift
        # backwards: the probability that a piece ends at j, dealt to the pieces that may
        ends = [0.0] * n + [1.0]
        for j, i, piece, p in sorted(edges, key=lambda e: -e[0]):
            if ends[j]:
                share = ends[j] * p * math.exp(at[i] - at[j])
                ends[i] += share
                counts[piece] = counts.get(piece, 0.0) + share


def fitted(words: DataFrame, model_path: str, rounds: int) -> dict[bytes, float]:
    """The weights of the model's pieces after rounds of expectation and maximization over the distinct training words of words(word, uses).

    Each word counts once: the lattice has to speak for words that were never seen, and these are like rare ones. Only a
    number for each piece comes to the driver.
    """
    start = weights = vocabulary(model_path)
    pieces = list(start)
    number = {p: i for i, p in enumerate(pieces)}
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            lattice, counts = Lattice(weights), {}
            for batch in batches:
                for w in batch.column("word").to_pylist():
                    lattice.expected(MARK + w, counts)
            if counts:
                yield pa.record_batch([pa.array([number[p] for p in counts], pa.int32()), pa.array(list(counts.values()), pa.float64())], names=["piece", "n"])
            give_back()

        found = {pieces[r.piece]: r.n for r in words.where("uses > 0").select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        if not (z := math.fsum(found.values())):
            break
        weights = {p: (1 - RANKS) * found.get(p, 0.0) / z + RANKS * x for p, x in start.items()}
    return weights


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8: A-Z lower-cased, split at ASCII white space."""
    yield text.lower().split()  # of bytes: both know ASCII only


def score_words(words: DataFrame, weights: dict[bytes, float], end: float) -> DataFrame:
    """(slice, data) of words(word, uses, at): each distinct word's training count and log10 probability, packed for the slices that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice({p: w * (1 - end) for p, w in weights.items()})
        parts: list[tuple] = []

        def flush() -> pa.RecordBatch:
            name, no, uses, score = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.lexsort((no, name))
            cuts = [0, *(np.flatnonzero(np.diff(name[order])) + 1).tolist(), len(name)]
            data = [W.squeeze(b"".join([np.array(len(o), "<i8").tobytes(), no[o].astype("<i8").tobytes(), uses[o].astype("<i8").tobytes(), score[o].astype("<f8").tobytes()])) for a, b in zip(cuts, cuts[1:]) for o in [order[a:b]]]
            return pa.record_batch([pa.array(name[order][cuts[:-1]]), pa.array(data, pa.binary())], names=["slice", "data"])

        for batch in batches:
            score = np.array([lattice.log_probability(MARK + w) for w in batch.column("word").to_pylist()]) / math.log(10)
            name, no, n = W.places_of(batch.column("at"))
            parts.append((name, no, np.repeat(batch.column("uses").to_numpy(), n), np.repeat(score, n)))
            if sum(len(x[0]) for x in parts) >= W.PAIRS:
                yield flush()
        if parts:
            yield flush()
        give_back()

    return words.mapInArrow(run, "slice long, data binary")


def score_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, rounds: int = 0) -> DataFrame:
    """Scores every whole text, learning from the rows whose crc32(id) modulo folds isn't 0.

    Returns (id, held_out, n_tokens, n_known, train_tokens, base_score, score, smoothed_score), all logarithms to base 10:
    base_score is that of add-ALPHA word unigrams, score the lattice's marginal probability. smoothed_score is that of
    the training words' counts, backed by the lattice as Witten and Bell do: (c + V * p) / (N + V) for a word counted c times
    with probability p. Pieces have the weights of their ranks, or those that rounds of fitting to the training words make of them (see fitted). Tokens are the words and one end. Null, empty and blank texts are an end alone. A null id counts as training. Rows are never told apart by
    id: repeated rows, and rows of one id with different texts, count and are scored each, with one row each in the
    result. Without training rows the end has half of all probability. An empty table gives no rows; other columns are not read.
    """
    fold = F.coalesce(crc_mod(id_col, folds) == 0, F.lit(False))
    own = docs.select(F.struct(F.col(id_col).alias("id"), fold.alias("held_out")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), (~fold).alias("counts"))
    id_type, id_kind = (x(docs.schema[id_col].dataType) for x in (lambda t: t.simpleString(), to_arrow_type))
    table = W.saved_slices(own, words_of, "binary")
    ends = table.where("at is not null and not id.held_out").count()
    words = saved(W.distinct_words(table), "distinct")
    distinct, total = words.agg(F.count_if(F.col("uses") > 0), F.coalesce(F.sum("uses"), F.lit(0))).first()
    n_train, n_kinds = total + ends, distinct + (ends > 0)
    end = ends / n_train if n_train > ends else 0.5
    packed = score_words(words, fitted(words, model_path, rounds), end)
    base = lambda c: np.log10((c + ALPHA) / (n_train + ALPHA * (n_kinds + 1)))

    def smoothed(c, s):
        """log10((c + V * 10 ** s) / (N + V)), also where 10 ** s is too small for a number of its own."""
        tail = np.log10(max(n_kinds, 1)) + np.asarray(s, float)
        head = np.log10(np.maximum(c, 1e-300))
        return np.where(np.asarray(c) > 0, np.logaddexp(head * math.log(10), tail * math.log(10)) / math.log(10), tail) - math.log10(n_train + max(n_kinds, 1))

    def assemble(rows: pa.Table, packed: pa.Table) -> pa.Table:
        parts = []
        for x in packed["data"].to_pylist():
            plain = W.unsqueeze(x)
            n = int(np.frombuffer(plain, "<i8", 1)[0])
            parts.append((*np.frombuffer(plain, "<i8", 2 * n, 8).reshape(2, -1), np.frombuffer(plain, "<f8", n, 8 + 16 * n)))
        no, uses, score = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(no)
        known, base_of, score = uses[order] > 0, base(uses[order]), score[order]
        smoothed_of = smoothed(uses[order], score)
        if not np.array_equal(no[order], np.arange(len(no))):
            raise ValueError("words of a slice are missing")
        texts = rows.filter(pc.is_valid(rows["at"]))
        out = []
        for x in texts["at"]:
            at = W.halves(x.as_py())
            out.append((len(at) + 1, int(known[at].sum()) + (ends > 0), n_train, float(base_of[at].sum() + base(ends)), float(score[at].sum() + math.log10(end)), float(smoothed_of[at].sum() + smoothed(ends, math.log10(end)))))
        ids = texts["id"].combine_chunks()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
        del parts, no, uses, score, order, known, base_of, smoothed_of, texts, out
        give_back()
        return pa.table([ids.field("id").cast(id_kind), ids.field("held_out"), *columns], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "smoothed_score"])

    return table.groupBy("slice").cogroup(packed.groupBy("slice")).applyInArrow(assemble, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, smoothed_score double")
