"""The pipeline's stages against brute force over a small corpus with planted copies and toxic documents."""

import hashlib
import random

import pytest
import tiktoken

import corpus_pipeline
from colloquy.llm import mixing, tokens, toxicity

WORDS = ["river", "table", "walks", "green", "morning", "letter", "window", "quiet", "paper", "garden", "stone", "music"]


def shingles(text):
    w = low(text).split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(9), [], []
    for i in range(400):
        t = [rng.choice(WORDS) for _ in range(rng.choice([30, 200]))]
        if i % 4 == 0:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(["grumblor", "snarkzit", "vexmoot"])
        rows.append((i, " ".join(t), "en", "hot" if i % 3 else f"s{i % 7}", len(" ".join(t))))
        labels.append((i, 1, int(i % 4 == 0)))
    for i in range(400, 440):  # exact copies but for case, and near copies of long clean texts
        src = rows[rng.choice([x for x in range(1, 400) if x % 4 and len(rows[x][1]) > 500])][1]
        t = src.upper() if i % 2 else src.replace("river", "rivers", 1)
        rows.append((i, t, "en", "hot", len(t)))
    rows += [(500, None, None, None, 0), (501, "", "en", "hot", 0), (502, " \n", None, "s1", 2), (None, "lone quiet paper", "en", "s2", 16)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [tuple(r) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    order = lambda rows: sorted(rows, key=str)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "toxicity":
            s = toxicity.scores(model, [(r[1] or "").encode() for r in kept])
            kept = [r for r, x in zip(kept, s) if x < toxicity.THRESHOLD]
            toxic = {r[0] for r in kept if r[0] is not None and r[0] < 400 and r[0] % 4 == 0}
            assert len(toxic) <= 5 and len([r for r in kept if r[0] is None or r[0] % 4 or r[0] >= 400]) >= 330
        elif name == "exact_dedup":
            best = {}
            for r in kept:
                k = low(r[1])
                if k not in best or (-1 if best[k][0] is None else best[k][0]) < (-1 if r[0] is None else r[0]):
                    best[k] = r
            kept = list(best.values())
        elif name == "simhash_near_dedup":
            f = {r[0]: shingles(r[1]) for r in kept}
            root = {i: i for i in f}
            key = lambda i: 1 << 60 if i is None else i

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for a in f:
                for b in f:
                    if a != b and alike(f[a], f[b]):
                        x, y = sorted((find(a), find(b)), key=key)
                        root[y] = x
            kept = [r for r in kept if find(r[0]) == r[0]]
        elif name == "mixing":
            plan = {r.id: r.copies for r in mixing.plan_mix(docs, repetition=corpus_pipeline.REPETITION).collect()}
            assert min(plan.values()) >= 1 and max(plan.values()) == 2
            kept = [r for r in kept for _ in range(plan[r[0]])]
        else:
            own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(tokens.default_vocabulary()), special_tokens={})
            exp = []
            for r in kept:
                ids = own.encode_ordinary(r[1] or "")
                exp.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
            assert order([tuple(r) for r in out.collect()]) == order(exp)
            assert order([tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]) == order(exp)
            break
        assert out.columns == docs.columns
        assert order([tuple(r) for r in out.collect()]) == order(kept), name
        out.write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
