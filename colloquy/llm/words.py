"""Texts as positions of distinct words, which the operators share that work on each distinct word once.

One pass cuts every text into words and leaves it behind as the numbers of its words, position by position. Words
are numbered within a slice of the texts that one task reads, so a word takes one row for each slice, however
often it stands there. The rows of words may be shuffled by word, and what is found goes back to the slices;
positions never move: they lie in a table that is bucketed by slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bucketed, give_back, scan_bytes, small_batches

#: A slice is closed at so many bytes of text or distinct words; a text is never cut, so a longer one is a slice alone.
SLICE_BYTES, SLICE_WORDS = 32 << 20, 400_000
#: The bytes of a batch of positions, and the words of a row.
BATCH_BYTES, WORDS_ROW = 4 << 20, 1 << 12
#: (word, slice) pairs that a task packs at once.
PAIRS = 1 << 18
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 100_000
#: Bits of a task's number, of a slice's within the task, and of a word's within the slice: together a long. More of any are refused.
TASK_BITS, SERIAL_BITS, NO_BITS = 20, 16, 27


class Numbers(dict):
    """A word -> its number within the slice, given at first sight."""

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n


def pack_halves(at: np.ndarray) -> bytes:
    """Numbers in order: the low halves, then the high halves, which are nearly all alike."""
    return at.astype("<u2").tobytes() + (at >> 16).astype("<u2").tobytes()


def halves(packed: bytes) -> np.ndarray:
    low, high = np.frombuffer(packed, "<u2").reshape(2, -1).astype(np.uint32)
    return low | high << 16


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of runs that begin at start and are size long, one after another."""
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if n + int(start.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((start - (ends - size)).astype(kind), size)
    out += np.arange(n, dtype=kind)
    return out


def starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def squeeze(plain: bytes) -> bytes:
    return len(plain).to_bytes(8, "little") + pa.Codec("zstd", compression_level=5).compress(plain, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def cut(docs: DataFrame, split: Callable[[bytes], Iterator[list]], kind: str) -> DataFrame:
    """Cuts docs(id, text binary, counts boolean): a row (slice, id, at) for each text, and the distinct words of each slice in rows (slice, no, words, uses).

    split gives the words of a text in steps; kind is their SQL type. Frequent words have the small numbers, which pack
    best; no is the number of the first word of a row. uses says how often a word stands in texts that count. A task holds
    the words and the places of one slice, and never its texts.
    """
    id_type, id_kind = docs.schema["id"].dataType.simpleString(), to_arrow_type(docs.schema["id"].dataType)
    schema = pa.schema([("slice", pa.int64()), ("id", id_kind), ("at", pa.binary()), ("no", pa.int32()), ("words", pa.list_(getattr(pa, kind)())), ("uses", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, numbers, read, often, uses = TaskContext.get().partitionId(), 0, Numbers(), 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        if task >= 1 << TASK_BITS:
            raise OverflowError(f"task {task} is beyond the number of tasks that a slice's name has room for")
        ids: list[pa.Array] = []
        texts: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            if serial >= 1 << SERIAL_BITS or len(numbers) > 1 << NO_BITS:
                raise OverflowError("a task has more slices, or a slice more words, than their names have room for")
            name, n = task << SERIAL_BITS | serial, len(numbers)
            order = np.argsort(-often[:n], kind="stable")
            new = np.empty(n, np.uint32)
            new[order] = np.arange(n, dtype=np.uint32)
            own, a, held = pa.concat_arrays(ids), 0, 0
            for b, x in enumerate(texts, 1):
                held += 4 * len(x)
                if held >= BATCH_BYTES or b == len(texts):
                    at = pa.array([pack_halves(new[y]) for y in texts[a:b]], pa.binary())
                    yield pa.record_batch([pa.array(np.full(b - a, name)), own.slice(a, b - a), at, *(pa.nulls(b - a, f.type) for f in list(schema)[3:])], schema=schema)
                    texts[a:b] = [None] * (b - a)
                    a, held = b, 0
            found = list(numbers)
            for k in range(0, n, WORDS_ROW):
                some = order[k : k + WORDS_ROW]
                row = [[name], [None], [None], [k], [[found[x] for x in some.tolist()]], [uses[some].tolist()]]
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            first = 0
            for k, (text, counts) in enumerate(zip(batch.column("text"), batch.column("counts").to_pylist())):
                raw = text.as_py() or b""
                places = np.concatenate([np.fromiter(map(numbers.__getitem__, some), np.uint32, len(some)) for some in split(raw)] or [np.zeros(0, np.uint32)])
                if len(often) < len(numbers):
                    often, uses = (np.concatenate([x, np.zeros(len(numbers), np.int64)]) for x in (often, uses))
                seen, n = np.unique(places, return_counts=True)
                often[seen] += n
                if counts:
                    uses[seen] += n
                texts.append(places)
                read += len(raw)
                if read >= SLICE_BYTES or len(numbers) >= SLICE_WORDS:
                    ids.append(batch.column("id").slice(first, k + 1 - first))
                    yield from close()
                    serial, numbers, read, first = serial + 1, Numbers(), 0, k + 1
                    ids, texts, often[:], uses[:] = [], [], 0, 0
            ids.append(batch.column("id").slice(first))
        if texts:
            yield from close()
        del ids, texts, numbers, often, uses
        give_back()

    return docs.select("id", "text", "counts").mapInArrow(run, f"slice long, id {id_type}, at binary, no int, words array<{kind}>, uses array<long>")


def saved_slices(docs: DataFrame, split: Callable[[bytes], Iterator[list]], kind: str) -> DataFrame:
    """cut(), written out and bucketed by slice."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(scan_bytes(docs) // BUCKET_BYTES, MOST_BUCKETS))
    return bucketed(cut(docs, split, kind), "words", "slice", buckets)


def distinct_words(slices: DataFrame) -> DataFrame:
    """(word, uses, at) of saved_slices(): each distinct word with its uses in all and its places, one for a slice: the slice's name and the word's number as one."""
    rows = slices.where("words is not null").select("slice", "no", F.posexplode(F.arrays_zip("words", "uses")).alias("k", "w"))
    place = F.shiftleft("slice", NO_BITS).bitwiseOR((F.col("no") + F.col("k")).cast("long"))
    rows = rows.select(F.col("w.words").alias("word"), F.col("w.uses").alias("uses"), place.alias("place"))
    # no sums before the shuffle: a word is there once for each slice
    return rows.repartition(F.col("word")).groupBy("word").agg(F.sum("uses").alias("uses"), F.collect_list("place").alias("at"))


def places_of(at: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, no, how many) of the places of words."""
    where = at.flatten().to_numpy()
    return where >> NO_BITS, (where & (1 << NO_BITS) - 1).astype(np.int32), at.value_lengths().to_numpy().astype(np.int64)
