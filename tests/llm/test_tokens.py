import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from colloquy.llm import bpe, lengths, tokens
from colloquy.llm import words as W


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(tokens.default_vocabulary()), special_tokens={})


def texts(n):
    rng = random.Random(6)
    fixed = [None, "", " ", "  a b\n", "don't 漢字 ١٢٣   x 🙂", "x" * 3000, "tab\t here", "the cat " * 50, " ", "a\xa0 b", "<|endoftext|>", "word " * 30_000]
    return fixed + ["".join(rng.choice(["ab", "'", "'s", " ", "\n", "\t", "é", "1", "!", "漢"]) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_pieces_keep_the_matches():
    find = tokens.matches()
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice(["a", "b'", "'s", " ", " ", "\n", "\t", "1", "é", "\xa0", "!", "漢", "."]) for _ in range(rng.randrange(14)))
        if (cut := tokens.pieces(t)) is not None:
            assert find(cut[0]) + [w for x in cut[1] for w in tokens.words_after_space(x)] == find(t), repr(t)


@pytest.mark.parametrize("small", [False, True])
def test_bpe_equals_the_library(spark, own, monkeypatch, small):
    if small:  # many slices and batches, words in many packs
        for name, value in (("SLICE_BYTES", 500), ("SLICE_WORDS", 50), ("PAIRS", 20), ("BATCH_BYTES", 200), ("WORDS_ROW", 7)):
            monkeypatch.setattr(W, name, value)
    rows = [*enumerate(texts(300)), (None, "no id"), (5, "second text of 5 " + "q" * 60), (6, texts(0)[6])]
    df = spark.createDataFrame([(*r, "w", b"d") for r in rows], "doc_id long, text string, word string, data binary")
    got = sorted([(str(r.id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(df, tokens.default_vocabulary()).collect()])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    exp = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        exp.append((str(i), len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(exp)


def test_long_texts_go_in_steps(own, monkeypatch):
    whole = [t or "" for t in texts(50)]
    numbers = W.Numbers()
    split = lambda t: [w for some in bpe.pre_tokens(t.encode()) for w in some]
    at = [np.array([numbers[w] for w in split(t)], np.uint32) for t in whole]
    once = [split(t) for t in whole]
    monkeypatch.setattr(bpe, "LONG_CHARS", 10)
    monkeypatch.setattr(bpe, "STEP", 7)
    assert once == [split(t) for t in whole] and all(np.array_equal(x, W.halves(W.pack_halves(x))) for x in at)
    packed = [W.squeeze(b"".join([np.array([len(part), sum(map(len, ids))], "<u4").tobytes(), *(W.pack_halves(np.array(x, np.uint32)) for x in ([numbers[w] for w in part], list(map(len, ids)), [y for x in ids for y in x]))])) for part in (list(numbers)[9:], list(numbers)[:9]) for ids in [[own.encode_ordinary(w) for w in part]]]
    have = bpe.Words(packed, bpe.token_bytes(tokens.default_vocabulary()))
    with pytest.raises(ValueError):
        bpe.Words(packed[:1], bpe.token_bytes(tokens.default_vocabulary()))
    with pytest.raises(ValueError):
        bpe.join_bytes(np.array([60_000]), bpe.token_bytes(tokens.default_vocabulary()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for t, x in zip(whole, at):
        ids = own.encode_ordinary(t)
        assert have.digests(x) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))


def test_bpe_ids_and_bytes(spark, own):
    df = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    got = {r.id: (r.ids, bytes(r.decoded)) for r in bpe.encode_decode(df, tokens.default_vocabulary(), digest=False).collect()}
    assert got == {1: (own.encode_ordinary("the cat"), b"the cat"), 2: ([], b"")}
    assert bpe.encode_decode(df.limit(0), tokens.default_vocabulary()).count() == 0


def test_decoding_as_a_join(spark, own):
    rows = [(i, own.encode_ordinary(t or "")) for i, t in enumerate(texts(40)[1:])] + [(99, None)]
    got = {r.id: bytes(r.decoded) for r in bpe.decode(spark.createDataFrame(rows, "id long, ids array<int>"), tokens.default_vocabulary()).collect()}
    assert got == {i: own.decode_bytes(ids or []) for i, ids in rows}


def test_histogram(spark, own):
    rows = [*enumerate(texts(200))]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, docs int")
    limits = lengths.context_limits(lengths.length_histogram(df, tokens.default_vocabulary())).cache()
    n = sorted(len(own.encode_ordinary(t or "")) for _, t in rows)
    for r in limits.collect():
        k = r.n_tokens
        within, beyond = [x for x in n if x <= k], [x for x in n if x > k]
        assert (r.docs, r.docs_within, r.tokens_within, r.docs_beyond, r.tokens_beyond) == (n.count(k), len(within), sum(within), len(beyond), sum(beyond))
        assert r.tokens_truncated == sum(min(x, k) for x in n) and abs(r.quantile - len(within) / len(n)) < 1e-12
    assert limits.count() == len({*n})
    for k in (0, 1, 17, 1000, 10**9):
        r = lengths.truncated_total(limits, k).first()
        assert (r.docs_truncated, r.tokens_truncated) == (sum(x > k for x in n), sum(min(x, k) for x in n))
    assert lengths.length_quantile(limits, 0.5).first().n_tokens == next(x for x in n if sum(y <= x for y in n) >= 0.5 * len(n))
    empty = lengths.context_limits(lengths.length_histogram(df.limit(0), tokens.default_vocabulary()))
    assert empty.count() == 0 and lengths.truncated_total(empty, 5).first().tokens_truncated == 0
