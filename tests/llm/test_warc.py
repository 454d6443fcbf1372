import base64
import hashlib
import random

import pytest

from colloquy.llm import warc_index as w

SCHEMA = "page_id long, url string, html string, key string, digest string, file string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "k", "d", "f") for r in rows], SCHEMA)
    got = w.archive_round_trip(df).collect()
    return sorted((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or "") for r in got)


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 1 << 62), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        f = first.get(h or "")
        new = i == f
        out.append(("null" if i is None else str(i), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if new else "revisit", "" if new else str(f)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    urls = [None, "", "http://a.b/c", "https://u@www.x.org:80/p?q#f", "bad url \n x", "http://é.fr/ü", "http://long.org/" + "y" * 5000]
    rows = [(i, rng.choice([*urls, f"http://h{i % 3}.com/{i}"]), rng.choice([None, "", "aa", "ééé", "x" * 50_000, str(i)])) for i in range(1500)]
    rows += [(None, "http://n", "only null"), (7, "http://n", "other"), (7, "http://n", "other")]
    assert run(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("limit", [0, 10**6])
def test_many_groups_take_the_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(w, "GROUPS_BROADCAST", limit)
    rows = [(i, f"http://x/{i}", str(i % 40) if i % 3 else "hot") for i in range(600)]
    assert run(spark, rows) == expected(rows)


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long one"), (4, "d", "long one")], "page_id long, url string, html string")
    got = {r.record_id: (r.record_type, r.refers_to) for r in w.archive_round_trip(df, least_bytes=2).collect()}
    assert got == {"1": ("response", None), "2": ("response", None), "3": ("response", None), "4": ("revisit", "3")}


def test_keys_sort_by_reversed_host():
    assert w.capture_key("http://News.Example.com:8080/a?b#c", "1").startswith("com,example,news:8080)/a?b ")
    assert w.capture_key(None, "1").split(" ")[0] == ")/"
    assert len(w.capture_key("http://x/" + "é" * 10_000, "1")) < 700


def test_record_round_trip():
    x = w.parse(w.record("5", "http://a/ b", "é\r\n\r\nz".encode(), None, 6))
    assert (x["payload"], x["record_type"], x["url"]) == ("é\r\n\r\nz".encode(), "response", "http://a/%20b")
    y = w.parse(w.record("6", None, b"abc", "5", 6))
    assert (y["payload"], y["payload_bytes"], y["refers_to"]) == (None, 3, "5")


def test_repeated_keys_over_range_partitions(spark, monkeypatch):
    monkeypatch.setattr(w, "LEAST_LINES", 8)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = [(i, f"http://x/{i}", f"own {i}") for i in range(100, 140) for _ in range(100 if i % 2 else 1)]
        assert run(spark, rows) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
