import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docloom.llm import winnowing as W
from tests.llm.rows import LONG, awkward, empty

SCHEMA = "doc_id long, text string"


def grams(text):
    return [text[i : i + W.GRAM] for i in range(len(text) - W.GRAM + 1)] or [text]


def engine_hashes(spark, texts):
    found = sorted({g for t in texts for g in grams(t)})
    df = spark.createDataFrame([(g,) for g in found], "g string").select("g", F.xxhash64("g").alias("h"))
    return {r["g"]: r["h"] >> 13 for r in df.collect()}


def slow(text, hash_of):
    h = [hash_of[g] for g in grams(text)]
    w, out = min(W.WINDOW, len(h)), []
    for i in range(len(h) - w + 1):
        least = min(h[i : i + w])
        place = max(k for k in range(i, i + w) if h[k] == least)
        if out[-1:] != [(place, least)]:
            out.append((place, least))
    return out


def as_text(picks):
    return ",".join(f"{h & (1 << 51) - 1:x}:{p}" for p, h in picks)


def likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b)


def expected(spark, docs):
    """docs: distinct (doc_id, text) with unique ids."""
    order = sorted(docs, key=lambda d: -d[0])
    texts = [t or "" for _, t in order]
    nexts = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts)]
    hash_of = engine_hashes(spark, texts + edited)
    out = {}
    for (doc_id, _), t, n, e in zip(order, texts, nexts, edited):
        a, b, c = (slow(x, hash_of) for x in (t, e, n))
        out[doc_id] = (len(t), hashlib.sha256(e.encode()).hexdigest(), as_text(a), as_text(b), likeness(a, b), likeness(a, c))
    return out


def check(spark, docs):
    got = W.edited_fingerprints(spark.createDataFrame(docs, SCHEMA)).collect()
    want = expected(spark, docs)
    assert len(got) == len(docs)
    for r in got:
        row = tuple(r)[1:]
        assert row[:4] == want[r["doc_id"]][:4], r["doc_id"]
        assert row[4:] == pytest.approx(want[r["doc_id"]][4:])


def test_agrees_with_brute_force_at_every_length(spark):
    rnd = random.Random(2)
    lengths = [0, 1, 15, 16, 17, 40, 78, 79, 80, 81, 157, 158, 159, 160, 161, 300, 4095, 4096, 4097, 4200, 9000]
    docs = [(i * 3, "".join(rnd.choice("abcé😀 \n") for _ in range(n))) for i, n in enumerate(lengths * 2)]
    docs += [(1000 + i, "ab" * n) for i, n in enumerate((3, 60, 3000))] + [(2000, None)]
    rnd.shuffle(docs)
    check(spark, docs)


def test_many_buckets_and_a_single_document(spark, monkeypatch):
    monkeypatch.setattr(W, "_BUCKET_CHARS", 300)
    docs = [(i * i - 50, f"document number {i} " * (i % 7 + 1)) for i in range(120)]
    check(spark, docs)
    check(spark, [(7, "the only document there is, which is its own next one, and long enough for windows" * 2)])


def test_awkward_rows(spark):
    got = W.edited_fingerprints(awkward(spark)).collect()
    assert len(got) == 13 and W.edited_fingerprints(empty(spark)).count() == 0
    rows = {(r["doc_id"], r["fingerprint"], r["edited_sha256"]) for r in got}
    # Repeated rows share a result; equal texts share a fingerprint.
    assert len(rows) == 11 and len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}) == 1
    long = [r for r in got if r["doc_id"] == 6]
    assert len(long) == 2 and long[0] == long[1] and long[0]["n_chars"] == len(LONG)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_shared_passages_share_a_hash(spark):
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(W.GRAM + W.WINDOW - 1))
    noise = ["".join(rnd.choice("ijklmnop ") for _ in range(200)) for _ in range(4)]
    docs = [(1, noise[0] + passage + noise[1]), (2, noise[2] + passage + noise[3])]
    found = W.fingerprints(spark.createDataFrame(docs, SCHEMA)).orderBy("doc_id").collect()
    a, b = ({p["hash"] for p in r["picks"]} for r in found)
    assert a & b
