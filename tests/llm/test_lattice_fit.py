import math
import random

from colloquy.llm import lattice_lm as m
from colloquy.llm import queries


def segmentations(word, weights):
    if not word:
        yield 1.0, []
    for k in range(1, len(word) + 1):
        if p := weights.get(word[:k]):
            yield from ((p * q, [word[:k], *rest]) for q, rest in segmentations(word[k:], weights))


def test_expected_counts_are_the_mean_over_segmentations():
    rng = random.Random(1)
    weights = {c: rng.random() / 10 for c in (b"a", b"b", b"ab", b"ba", b"aab", b"bbb", b"abab")}
    for _ in range(60):
        w, want, got = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 11))), {}, {}
        every = list(segmentations(w, weights))
        z = sum(p for p, _ in every)
        for p, pieces in every:
            for x in pieces:
                want[x] = want.get(x, 0.0) + p / z
        m.Lattice(weights).expected(w, got)
        assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], rel_tol=1e-9) for x in want)
    m.Lattice(weights).expected(b"ab" * 5000, long := {})
    assert math.isclose(sum(len(x) * n for x, n in long.items()), 10_000, rel_tol=1e-6)


def test_fitted_pieces_are_a_distribution_that_the_words_like_better(spark):
    words = spark.createDataFrame([(bytearray(b"thtionoues"), 3), (bytearray(b"ereror"), 1), (bytearray(b"unseen"), 0)], "word binary, uses long")
    start, weights = m.vocabulary(m.default_pieces()), m.fitted(words, m.default_pieces(), 2)
    assert math.isclose(sum(weights.values()), 1.0, rel_tol=1e-9) and min(weights.values()) > 0 and weights.keys() == start.keys()
    for w in (b"thtionoues", b"ereror"):
        assert m.Lattice(weights).log_probability(m.MARK + w) > m.Lattice(start).log_probability(m.MARK + w) + 1
    assert m.fitted(words.where("uses = 0"), m.default_pieces(), 2) == start


def test_score_of_the_query_is_near_the_base_on_held_out_rows(spark):
    rows = queries.op5_subword_lattice_likelihood(spark, "/root/testdata/sf0.001").where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert rows and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens - 1.5
