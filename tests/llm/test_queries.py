"""The registered queries on the smallest tables, column by column against plain Python."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest
import tiktoken
import xxhash

from colloquy.llm import langid, queries, tokens, ts_media

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def table(name):
    return duckdb.sql(f"SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')").fetchall()


@pytest.fixture(scope="module")
def docs():
    return {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{FOLDER}/documents.parquet')").fetchall()}


def run(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    return dict(df.dtypes), df.collect()


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", low(text)) if w]


def held_out(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_op1(spark):
    kinds, got = run(spark, "op1_warc_capture_index")
    pages = {r[0]: (r[2] or "").encode() for r in duckdb.sql(f"SELECT page_id, url, html FROM read_parquet('{FOLDER}/pages.parquet')").fetchall()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    exp = [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, p in pages.items()]
    assert sorted(tuple(r)[:5] for r in got) == sorted(exp) and kinds["payload_bytes"] == "bigint"


def test_op2(spark, docs):
    kinds, got = run(spark, "op2_transport_stream_media")
    assert {kinds[c] for c in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")} == {"bigint"} and len(got) == len(docs)
    features = {}
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        p = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        m = ts_media.mux(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(data), len(p), sha(p), zlib.crc32(p[-64:]), len(m), sha(m))
        assert features.setdefault(docs[r.doc_id] or "", r.feature) == r.feature and "lost=0 broken=0 damaged=0" in r.feature


def test_op3(spark, docs):
    _, got = run(spark, "op3_simhash_gray_index")

    def fingerprint(text):
        w = split(text)
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    f = {i: fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in f}
    for i in sorted(f):  # every component by its smallest member
        for j in sorted(f):
            if (f[i] ^ f[j]).bit_count() <= 2 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{x:016x}", root[i]) for i, x in f.items()}


def test_op4_and_op10(spark, docs):
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(tokens.default_vocabulary()), special_tokens={})
    ids = {i: own.encode_ordinary(t or "") for i, t in docs.items()}
    kinds, got = run(spark, "op10_byte_level_bpe")
    assert kinds["n_tokens"] == "bigint"
    assert {tuple(r) for r in got} == {(i, len(x), sha(",".join(map(str, x)).encode()), sha((docs[i] or "").encode())) for i, x in ids.items()}
    n = Counter(map(len, ids.values()))
    assert {r.n_tokens: r.docs for r in run(spark, "op4_token_length_histogram")[1]} == n


def test_op5(spark, docs):
    kinds, got = run(spark, "op5_subword_lattice_likelihood")
    train = [t for i, t in docs.items() if not held_out(i, 10, 0)]
    c, ends = Counter(w for t in train for w in split(t)), len(train)
    n, v = sum(c.values()) + ends, len(c) + 1
    for r in got:
        w = split(docs[r.doc_id])
        base = sum(math.log10((k + 0.1) / (n + 0.1 * (v + 1))) for k in [*(c[x] for x in w), ends])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id, 10, 0), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and math.isfinite(r.score)
    assert {kinds[x] for x in ("n_tokens", "n_known", "train_tokens")} == {"bigint"} and len(got) == len(docs)


def test_op6_and_op9(spark, docs):
    kinds, got = run(spark, "op6_toxicity_subword_softmax")
    assert kinds["predicted"] == "int" and {r.doc_id for r in got} == set(docs)
    assert all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    lang = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, lang FROM read_parquet('{FOLDER}/documents.parquet')").fetchall()}
    _, got = run(spark, "op9_language_id_subword_softmax")
    learned = {v for i, v in lang.items() if v is not None and not held_out(i, 4, 2)}
    for r in got:
        letters = any(ch.isalpha() for ch in docs[r.doc_id] or "")
        assert r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.lang_pred in (learned if letters else {langid.UNKNOWN})
    known = [(r.lang_pred, lang[r.doc_id]) for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != langid.UNKNOWN]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)


def test_op7(spark, docs):
    _, got = run(spark, "op7_exact_dedup_heavy_hitters")
    groups = {}
    for i, t in docs.items():
        groups.setdefault(low(t), []).append(i)
    exp = {(i, max(g), len(g), i == max(g), sha(t.encode())) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in got} == exp


def test_op8(spark, docs):
    _, got = run(spark, "op8_temperature_mixing")
    source = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, source FROM read_parquet('{FOLDER}/documents.parquet')").fetchall()}
    words, mixed, weight = Counter(), Counter(), {}
    for r in got:
        assert r.n_tokens == len(split(docs[r.doc_id])) and r.source == source[r.doc_id] and r.copies >= 1
        words[r.source] += r.n_tokens
        mixed[r.source] += r.n_tokens * r.copies
        weight[r.source] = r.weight
    whole = sum(words.values())
    assert math.isclose(sum(weight.values()), 1.0, rel_tol=1e-9)
    # the flattest power of the shares in which no source is repeated over twice as often as another
    ratio = [weight[s] / (words[s] / whole) for s in words if words[s]]
    assert max(ratio) / min(ratio) <= 2 * (1 + 1e-6)
    x = [math.log(weight[a] / weight[b]) / math.log(words[a] / words[b]) for a in words for b in words if words[a] > words[b] > 0]
    assert max(x) - min(x) < 1e-6 and 0 <= min(x) <= 1


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, FOLDER)
        exp = con.execute(sql)
        names = [c[0] for c in exp.description]
        assert sorted(names) == sorted(df.columns) and sorted(map(str, exp.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect()), name
