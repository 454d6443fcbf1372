"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens ("words") with their positions (see words.py). The distinct words of each slice are
shuffled by word: each distinct word meets itself there and is encoded once. Its ids are joined back to the slices, and
there with the table of token bytes, which decodes them; texts are put together by position. Positions never
move; only words are shuffled.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens
from . import words as W
from .common import give_back, small_batches

#: Texts of more characters are cut into words in steps; places of a text that are put together at once.
LONG_CHARS, STEP = 1 << 22, 1 << 18
#: The token-byte table is broadcast. No vocabulary with more tokens is taken.
MOST_TOKENS = 1 << 20


def pre_tokens(text: bytes) -> Iterator[list[str]]:
    """The words of a text, those of a long one in steps."""
    whole = text.decode("utf-8", "replace")
    if len(whole) <= LONG_CHARS:
        yield tokens.matches()(whole)
        return
    found = tokens.pattern().finditer(whole)
    while some := [m.group() for m in islice(found, STEP)]:
        yield some


def token_bytes(vocabulary: str) -> pa.Table:
    """(token, bytes): the vocabulary file as a table."""
    ranks = tokens.ranks(vocabulary)
    if len(ranks) > MOST_TOKENS or max(ranks.values(), default=0) >= MOST_TOKENS:
        raise ValueError(f"{len(ranks)} tokens are more than {MOST_TOKENS}")
    return pa.table({"token": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())}).sort_by("token")


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """(slice, data) of words(word, at): the ids of each distinct word, encoded once and packed for the slices that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, parts = tokens.encoder(vocabulary), []

        def flush() -> pa.RecordBatch:
            name, no, n_at, n_ids, token = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.argsort(name, kind="stable")  # words stay in their order, which packs best
            word = np.repeat(np.arange(len(n_at)), n_at)[order]
            name, no, at_id, n_ids = name[order], no[order], W.starts(n_ids)[word], n_ids[word]
            cuts = [0, *(np.flatnonzero(np.diff(name)) + 1).tolist(), len(name)]
            data = []
            for a, b in zip(cuts, cuts[1:]):
                t = token[W.gather(at_id[a:b], n_ids[a:b])]
                data.append(W.squeeze(b"".join([np.array([b - a, len(t)], "<u4").tobytes(), *(W.pack_halves(x) for x in (no[a:b], n_ids[a:b], t))])))
            return pa.record_batch([pa.array(name[cuts[:-1]]), pa.array(data, pa.binary())], names=["slice", "data"])

        for batch in batches:
            ids = [encode(w.as_py().encode()) for w in batch.column("word")]
            n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
            token = np.fromiter(chain.from_iterable(ids), np.int32, int(n_ids.sum()))
            parts.append((*W.places_of(batch.column("at")), n_ids, token))
            if sum(len(x[0]) for x in parts) >= W.PAIRS:
                yield flush()
        if parts:
            yield flush()
        give_back()

    return words.mapInArrow(run, "slice long, data binary")


@functools.lru_cache(1)
def decimals(bits: int) -> pa.Array:
    """The decimal texts of all ids of so many bits, each with a comma."""
    return pa.array([b"%d," % i for i in range(1 << bits)], pa.binary())


def _data(a: pa.Array) -> memoryview:
    """The bytes of all values of a binary array, one after another."""
    ends = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset)
    return memoryview(a.buffers()[2] or b"")[ends[0] : ends[-1]]


def _runs(raw: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary array of runs of raw."""
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])


def _joined(a: pa.Array, n: np.ndarray) -> pa.Array:
    """Runs of n values of a binary array, each as one value."""
    return _runs(np.frombuffer(_data(a), np.uint8), np.add.reduceat(pc.binary_length(a).to_numpy(), W.starts(n)) if len(n) else n)


def join_bytes(ids: np.ndarray, table: pa.Table) -> pa.Array:
    """The bytes of each id, joined from a table of tokens in order. Its key is dense, or nearly, so the join is one gather."""
    tokens_of = table["token"].to_numpy()
    dense = np.full(int(tokens_of[-1]) + 1 if len(tokens_of) else 1, -1)
    dense[tokens_of] = np.arange(len(tokens_of))
    if len(ids) and (ids.max() >= len(dense) or (dense[ids] < 0).any()):
        raise ValueError("an id is not in the table of tokens")
    return table["bytes"].combine_chunks().take(pa.array(dense[ids]))


class Words:
    """The words of a slice by number: ids, their decimal text, and decoded bytes. packed: what came back for the slice; table: the bytes of tokens."""

    def __init__(self, packed: list[bytes], table: pa.Table):
        parts = []
        for x in packed:
            plain = W.unsqueeze(x)
            n, n_t = np.frombuffer(plain, "<u4", 2).tolist()
            cuts = np.cumsum([8, 4 * n, 4 * n, 4 * n_t]).tolist()
            parts.append([W.halves(plain[a:b]) for a, b in zip(cuts, cuts[1:])])
        no, n_ids, token = (np.concatenate(x).view(np.int32) for x in zip(*parts)) if parts else (np.zeros(0, np.int32),) * 3
        del parts
        order = np.argsort(no)
        if not np.array_equal(no[order], np.arange(len(no))):
            raise ValueError("words of a slice are missing")
        self.n_ids = n_ids[order]
        self.token, self.first = token[W.gather(W.starts(n_ids)[order], self.n_ids)], W.starts(self.n_ids)
        self.text = _joined(decimals(int(self.token.max(initial=0)).bit_length()).take(pa.array(self.token)), self.n_ids)
        self.bytes = _joined(join_bytes(self.token, table), self.n_ids)

    def digests(self, at: np.ndarray) -> tuple[int, str, str]:
        """(n_tokens, ids_sha256, decoded_sha256) of the words at these places."""
        ids, data = hashlib.sha256(), hashlib.sha256()
        for k in range(0, len(at), STEP):
            part = pa.array(at[k : k + STEP])
            text = _data(self.text.take(part))
            ids.update(text if k + STEP < len(at) else text[: len(text) - 1])  # no comma behind the last
            data.update(_data(self.bytes.take(part)))
        return int(self.n_ids[at].sum()), ids.hexdigest(), data.hexdigest()

    def whole(self, at: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(ids, decoded) of the words at these places."""
        return self.token[W.gather(self.first[at], self.n_ids[at])], bytes(_data(self.bytes.take(pa.array(at))))


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns for every row (id, n_tokens, ids_sha256, decoded_sha256), or with digest=False (id, ids array<int>,
    decoded binary). Null and empty texts have no ids. Rows are never told apart by id, so repeated ids, repeated
    rows and null ids give a row each. An empty table gives no rows; other columns are not read. Bytes that are no
    UTF-8 are read as replacement characters.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.lit(False).alias("counts"))
    id_type, id_kind = own.schema["id"].dataType.simpleString(), to_arrow_type(own.schema["id"].dataType)
    slices = W.saved_slices(own, pre_tokens, "string")
    packed = encode_words(W.distinct_words(slices).select("word", "at"), vocabulary)
    table = docs.sparkSession.sparkContext.broadcast(token_bytes(vocabulary))  # MOST_TOKENS rows at most

    def assemble(rows: pa.Table, packed: pa.Table) -> pa.Table:
        have = Words([x.as_py() for x in packed["data"]], table.value)
        got = [(have.digests if digest else have.whole)(W.halves(x.as_py())) for x in rows["at"]]
        kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.binary()]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
        columns = zip(*got) if got else [[]] * len(kinds)
        out = pa.table([rows["id"].cast(id_kind), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", *names])
        del have, got, rows, packed
        give_back()
        return out

    result = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    texts = slices.where("at is not null").select("slice", "id", "at")
    return texts.groupBy("slice").cogroup(packed.groupBy("slice")).applyInArrow(assemble, f"id {id_type}, {result}")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "id") -> DataFrame:
    """(id, decoded) of encoded(id, ids array<int>), whose ids differ: every id with its place, joined with the table of tokens, and put in order again.

    Texts without ids (null or empty) have no bytes. An id that is no token fails.
    """
    spark = encoded.sparkSession
    small_batches(spark)
    table = F.broadcast(spark.createDataFrame(token_bytes(vocabulary)))  # MOST_TOKENS rows at most
    each = encoded.select(F.col(id_col).alias("id"), F.posexplode_outer("ids").alias("pos", "token"))
    found = each.join(table, "token", "left").withColumn("hex", F.when(F.col("token").isNotNull(), F.coalesce(F.hex("bytes"), F.raise_error(F.lit("an id is not in the table of tokens")))))
    whole = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "hex"))).alias("parts"))
    return whole.select("id", F.unhex(F.array_join(F.transform("parts", lambda p: p.hex), "")).alias("decoded"))
