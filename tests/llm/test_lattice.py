import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import lattice_lm as m
from colloquy.llm import words as W


def segmentations(word, weights):
    if not word:
        return 1.0
    return sum(p * segmentations(word[k:], weights) for k in range(1, len(word) + 1) if (p := weights.get(word[:k])))


def test_forward_is_the_sum_over_segmentations():
    rng = random.Random(1)
    weights = {c: rng.random() / 10 for c in (b"a", b"b", b"ab", b"ba", b"aab", b"bbb", b"abab")}
    lattice = m.Lattice(weights)
    for _ in range(200):
        w = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12)))
        assert math.isclose(math.exp(lattice.log_probability(w)), segmentations(w, weights), rel_tol=1e-9)


def test_long_words_do_not_underflow():
    vocabulary = m.vocabulary(m.default_pieces())
    assert math.isclose(sum(vocabulary.values()), 1.0, rel_tol=1e-9)
    lattice = m.Lattice(vocabulary)
    w = b"q" * 3000 + "é漢".encode() * 200
    f = [-math.inf] * (len(w) + 1)
    f[0] = 0.0
    for i in range(len(w)):
        for j in range(i + 1, min(len(w), i + lattice.longest) + 1):
            if p := lattice.weights.get(w[i:j]):
                f[j] = np.logaddexp(f[j], f[i] + math.log(p))
    assert math.isclose(f[-1], lattice.log_probability(w), rel_tol=1e-9)


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, monkeypatch, small):
    if small:  # many slices and packs
        for name, value in (("SLICE_BYTES", 300), ("SLICE_WORDS", 20), ("PAIRS", 9), ("BATCH_BYTES", 50), ("WORDS_ROW", 4)):
            monkeypatch.setattr(W, name, value)
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", " ", "The cat sat", "the dog " + "z" * 40, "Ünï cödé " * 5, f"unique{i} word"])) for i in range(300)] + [(None, "q r s"), (5, "the other"), (5, "the other"), (7, "long " * 20_000)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    words_of = lambda t: (t or "").encode().lower().split()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    train = [t for i, t in rows if not out(i)]
    c, ends = Counter(w for t in train for w in words_of(t)), len(train)
    n, v = sum(c.values()) + ends, len(c) + 1
    got = m.score_documents(df, m.default_pieces()).collect()
    base = lambda t: sum(math.log10((k + 0.1) / (n + 0.1 * (v + 1))) for k in [*(c[w] for w in words_of(t)), ends])
    near = lambda x: round(x, 5)
    assert sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, near(r.base_score)) for r in got) == sorted((str(i), out(i), len(words_of(t)) + 1, sum(c[w] > 0 for w in words_of(t)) + 1, n, near(base(t))) for i, t in rows)
    end = ends / n
    lattice = m.Lattice({p: w * (1 - end) for p, w in m.vocabulary(m.default_pieces()).items()})
    model = lambda t: sum(lattice.log_probability(m.MARK + w) for w in words_of(t)) / math.log(10) + math.log10(end)
    assert sorted((str(r.id), near(r.score)) for r in got) == sorted((str(i), near(model(t))) for i, t in rows)
    kinds = len(c) + 1
    share = lambda k, p: math.log10((k + kinds * p) / (n + kinds))
    smooth = lambda t: sum(share(c[w], math.exp(lattice.log_probability(m.MARK + w))) for w in words_of(t)) + share(ends, end)
    assert sorted((str(r.id), near(r.smoothed_score)) for r in got if (r.n_tokens < 1000)) == sorted((str(i), near(smooth(t))) for i, t in rows if len(words_of(t)) < 999)


def test_empty_table(spark):
    assert m.score_documents(spark.createDataFrame([], "doc_id long, text string"), m.default_pieces()).count() == 0
