"""The operators that learn: quality, toxicity, secrets and the language model."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import hmm, quality, secret_scan, toxicity
from docloom.llm.common import sha256_hex
from tests.llm.rows import LONG, awkward, empty

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# --- quality ---


def test_quality_keeps_good_and_rejects_bad_documents(spark, documents, labels):
    kept = {r["doc_id"] for r in quality.sampled(documents, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [d in kept for d, q in truth.items() if q == 1]
    bad = [d in kept for d, q in truth.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    filtered = quality.keep_quality(documents, labels)
    assert filtered.schema == documents.schema and {r["doc_id"] for r in filtered.select("doc_id").collect()} == kept


def test_quality_weights_agree_with_counting(spark, documents, labels):
    model = quality.fit_quality(documents, labels)
    raw = Counter()
    for r in documents.collect():
        raw.update(quality.hashed_ngrams(r["text"].encode()).tolist())
    assert len(model.log_ratio) == quality.BUCKETS
    text = documents.first()["text"].encode()
    tokens = re.findall(rb"[0-9a-z\x80-\xff]+|[^\x00-\x200-9a-z\x80-\xff]+", text.lower())
    grams = quality.hashed_ngrams(text)
    assert len(grams) == 2 * len(tokens) - 1
    assert model.log_weight(text) == pytest.approx(100 * np.mean([model.log_ratio[g] for g in grams]))
    # Buckets that only rejected text fills weigh against it.
    unseen = [b for b in range(quality.BUCKETS) if b not in raw]
    assert np.ptp(model.log_ratio[unseen]) < 0.5


def test_top_k_takes_exactly_k(spark, documents, labels):
    drawn = quality.sampled(documents, labels, k=100).collect()
    assert len(drawn) == 100
    scored = quality.resample(documents, labels, k=100).scored.collect()
    best = sorted((r["noisy"] for r in scored), reverse=True)[:100]
    assert sorted((r["noisy_weight"] for r in drawn), reverse=True) == pytest.approx(best)
    assert quality.sampled(documents, labels, k=0).count() == 0


def slow_grams(text):
    """Buckets of the tokens and of their neighbouring pairs, in whole-number arithmetic."""
    tokens, now, kind = [], b"", None
    for byte in text.lower():
        b = bytes([byte])
        own = "space" if byte <= 32 else "word" if b.isalnum() or byte >= 128 else "mark"
        if own != kind and now:
            tokens.append(now)
            now = b""
        kind = own
        now = now + b if own != "space" else b""
    tokens += [now] if now else []
    h = [zlib.crc32(t) for t in tokens]
    h += [a * int(quality._LEFT) + b * int(quality._RIGHT) for a, b in zip(h, h[1:])]
    return [(x * int(quality._MIX)) % 2**64 >> 64 - quality.BUCKET_BITS for x in h]


def test_drawn_documents_agree_with_a_slow_version(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text").where("doc_id is null"))
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = [tuple(r) for r in docs.collect()]
    bad = {r["doc_id"] for r in labels.collect() if r["quality"] == 0}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1} - bad
    # The only things taken from the library: its uniform numbers.
    draw = docs.distinct().select("doc_id", quality.uniform("doc_id", seed=quality.SEED), quality.uniform("doc_id", seed=quality.SEED + 1)).collect()
    part, noise = {d: u for d, u, _ in draw}, {d: -math.log(-math.log(u)) for d, _, u in draw}
    grams = [slow_grams((t or "").encode()) for _, t in rows]
    raw, target = Counter(), Counter()
    for (d, _), found in zip(rows, grams):
        raw.update(found)
        if d in good and part[d] < quality.TARGET_SHARE:
            target.update(found)
    n, m, buckets, prior = sum(raw.values()), sum(target.values()), 2**quality.BUCKET_BITS, quality.PRIOR * 2**quality.BUCKET_BITS

    def log_ratio(g):
        p = (raw[g] + 1) / (n + buckets)
        return math.log((target[g] + prior * p) / ((m + prior) * p))

    weights = [100 * sum(map(log_ratio, found)) / len(found) if found else 0.0 for found in grams]
    held = sorted(w for (d, _), w in zip(rows, weights) if d in good and part[d] >= quality.TARGET_SHARE)
    least = held[int((1 - quality.RECALL) * (len(held) - 1))]
    for k in (None, 17):
        size = sum(w >= least - 1e-9 for w in weights) if k is None else k
        noisy = [w + noise[d] for (d, _), w in zip(rows, weights)]
        cut = sorted(noisy, reverse=True)[size - 1]
        want = sorted(((d, round(w, 6), round(y, 6)) for (d, _), w, y in zip(rows, weights, noisy) if y >= cut - 1e-9), key=repr)
        got = quality.sampled(docs, labels, k=k).collect()
        assert sorted(((r["doc_id"], round(r["log_weight"], 6), round(r["noisy_weight"], 6)) for r in got), key=repr) == want


def test_quality_of_awkward_rows(spark, labels):
    docs = awkward(spark)
    assert quality.keep_quality(docs, no_labels(spark)).count() == 13
    got = quality.sampled(docs, no_labels(spark)).collect()
    assert len(got) == 13 and {r["log_weight"] for r in got if r["doc_id"] in (3, 4, 5)} == {0.0}
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, 1, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    assert quality.sampled(docs, some).count() <= 13
    assert quality.sampled(empty(spark), labels).count() == 0


# --- toxicity ---


def test_toxicity_is_found_on_held_out_documents(spark, labels):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, test = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    model = toxicity.fit_toxicity(documents, train)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score_toxicity(documents.join(test.select("doc_id"), "doc_id"), model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in test.collect()}
    found = np.mean([got[d] for d, t in truth.items() if t == 1])
    false = np.mean([got[d] for d, t in truth.items() if t == 0])
    assert found > 0.85 and false < 0.02


def test_later_models_read_earlier_probabilities():
    rng = np.random.default_rng(0)
    hashes = [np.unique(rng.integers(1, 60, 8).astype(np.uint32)) for _ in range(600)]
    toxic = np.array([float(7 in h) for h in hashes])
    model = toxicity.fit_chain(hashes, toxic, np.arange(600) % 5)
    assert [len(e) for e in model.earlier] == [0, 1, 2] and model.earlier[1][0] > 0
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1.0, 1, 0, 0])) == 0.5


def word_table(n=400, seed=5):
    rng = np.random.default_rng(seed)
    dense = (rng.random((n, 40)) < 0.2).astype(float)
    toxic = (dense @ np.concatenate([np.full(4, 2.0), np.full(4, -1.0), np.zeros(32)]) + rng.normal(0, 0.5, n) > 1.5).astype(float)
    return dense, toxic


def test_linear_fit_reaches_the_ridge_optimum_of_the_words_chosen():
    dense, y = word_table()
    rows = toxicity._rows([np.flatnonzero(r) for r in dense])
    earlier = np.random.default_rng(6).normal(size=(len(y), 2))
    model = toxicity.fit_linear(rows, earlier, y, 40)
    # Chi-square of presence and class, word by word.
    chosen = []
    for w in range(40):
        total, positive, share = dense[:, w].sum(), dense[y == 1, w].sum(), y.mean()
        chi = (positive - total * share) ** 2 / (total * share * (1 - share) * (1 - total / (len(y) + 1)))
        chosen += [w] if total >= toxicity.MIN_DOCUMENTS and chi >= 2 * math.log(40 / toxicity._CHANCE) else []
    assert sorted(np.flatnonzero(model.words)) == chosen and 2 <= len(chosen) <= 10
    full = np.hstack([dense[:, chosen], earlier, np.ones((len(y), 1))])
    ridge = np.diag([toxicity._RIDGE] * (full.shape[1] - 1) + [0.0])
    best = np.zeros(full.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ best))
        best -= np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + ridge, full.T @ (p - y) + ridge @ best)
    np.testing.assert_allclose(np.concatenate([model.words[chosen], model.earlier, [model.bias]]), best, rtol=0.03, atol=0.01)


def test_scores_of_a_table_agree_with_a_slow_chain(spark):
    dense, toxic = word_table()
    texts = [" ".join(f"word{w}" for w in np.flatnonzero(r)) for r in dense]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "word1 new"), (1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert len(model.hashes) and all(len(e) == c for c, e in enumerate(model.earlier))
    weight = {int(h): w for h, w in zip(model.hashes, model.words)}
    for r in toxicity.score_toxicity(docs, model).join(docs, "doc_id").collect():
        found = {zlib.crc32(w.encode()) for w in (r["text"] or "").split()}
        before = []
        for c in range(3):
            z = model.bias[c] + sum(weight[h][c] for h in found if h in weight) + sum(w * x for w, x in zip(model.earlier[c], before))
            p = 1 / (1 + math.exp(-z))
            q = min(max(p, 1e-4), 1 - 1e-4)
            before.append(math.log(q / (1 - q)))
            assert r[f"p_{toxicity.CATEGORIES[c]}"] == pytest.approx(p)
        assert r["toxic"] == (r["p_toxic"] >= model.thresholds[1])


def test_toxicity_of_awkward_rows(spark, labels):
    docs = awkward(spark)
    got = toxicity.toxicity(docs, no_labels(spark)).collect()
    assert len(got) == 13 and not any(r["toxic"] for r in got)
    one_kind = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert not any(r["toxic"] for r in toxicity.toxicity(docs, one_kind).collect())
    assert toxicity.toxicity(empty(spark), labels).count() == 0


# --- secrets ---


def slow_spans(text):
    text = text or ""
    keyword = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    kinds = [
        ("assign", keyword + "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)]
    return [f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(found)]


TRICKY = [
    'secret="token" = "abcdefgh1"',
    "PASSWORD: hunter2!x passwd='abc' api_key=ABCDEF apikey : x.y/z+=-_",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " AKIAKIA" + "C" * 20 + "d",
    "0123456789abcdef0123456 0123456789abcdef01234567 x" + "f" * 60 + "G",
    "ſecret=abcdefg toKen=abcdefgh é😀 token = 'deadbeefdeadbeefdeadbeef'",
    "token=token=abcdef:password==abcdefg",
]


def test_fixed_spans_agree_with_the_rules():
    for text in TRICKY + [LONG, "", 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b']:
        got = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in secret_scan.base_spans(text)]
        assert got == slow_spans(text), text[:60]


def test_whole_table_and_learned_spans(spark, documents):
    got = {r["doc_id"]: r for r in secret_scan.secrets(documents).collect()}
    assert len(got) == 1000
    for r in documents.collect():
        want, have = slow_spans(r["text"]), got[r["doc_id"]]
        assert have["base_sha256"] == sha256_hex(",".join(want))
        assert (have["n_assign"], have["n_access"], have["n_hex"]) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        spans = have["spans"].split(",") if have["spans"] else []
        assert [s for s in spans if not s.startswith("learned")] == want and len(spans) - len(want) == have["n_learned"]


def flagged(model, run):
    text = f"we looked at {run} and then went on"
    parts = [p for c in secret_scan.candidates(text) for p in secret_scan.stretches(*c)]
    return bool(parts) and (model.probabilities(np.stack([secret_scan.window(text, a, b) for a, b in parts])) >= model.threshold).any()


def test_bare_keys_are_found_and_names_are_not(documents):
    model = secret_scan.fit_secrets(documents)
    rng = np.random.default_rng(9)
    digits, upper, lower = secret_scan._DIGITS, secret_scan._UPPER, secret_scan._LOWER

    def key(letters, n):
        return "".join(letters[i] for i in rng.integers(0, len(letters), n))

    keys = {
        "base62": lambda: key(digits + upper + lower, 40),
        "behind a prefix": lambda: "sk_live_" + key(digits + upper + lower, 36),
        "upper-case hex": lambda: key(digits + "ABCDEF", 40),
        "base64": lambda: key(digits + upper + lower + "+/", 43) + "=",
        "lower case": lambda: key(digits + lower, 32),
        "after a path of 48 characters": lambda: "usr/share/local/some/config/directory/with/long1/" + key(digits + upper + lower, 40),
    }
    words = [w for r in documents.limit(200).collect() for w in r["text"].split() if w.isascii() and w.isalpha()]
    names = {
        "path": lambda: "/".join(rng.choice(words, 5)) + f"/{rng.integers(100)}",
        "long path": lambda: "/".join(rng.choice(words, 25)) + f"/{rng.integers(100)}",
        "slug": lambda: "-".join(rng.choice(words, 4)) + f"-{rng.integers(2030)}",
        "name": lambda: "_".join(rng.choice(words, 3)).upper() + str(rng.integers(9)),
        "time": lambda: f"2024-{rng.integers(10, 13)}-{rng.integers(10, 29)}-{rng.integers(10, 20)}-{rng.integers(10, 59)}",
        "number": lambda: str(rng.integers(10**17, 10**18)),
    }
    for kind, make in keys.items():
        assert np.mean([flagged(model, make()) for _ in range(100)]) >= 0.9, kind
    for kind, make in names.items():
        assert np.mean([flagged(model, make()) for _ in range(100)]) <= 0.01, kind


def test_windows_cover_a_run_of_any_length():
    for n in (16, 48, 49, 72, 73, 1000):
        parts = secret_scan.stretches(5, 5 + n)
        assert parts[0][0] == 5 and parts[-1][1] == 5 + n and all(b - a <= secret_scan.INSIDE for a, b in parts)
        assert all(c <= b for (_, b), (c, _) in zip(parts, parts[1:]))


def test_network_learns_and_its_gradients_are_right():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeiouthnrs"), 20)) for _ in range(150)]
    keys = ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(150)]
    texts = [f"some words {w} and more" for w in words] + [f"some words {k} and more" for k in keys]
    windows = np.stack([secret_scan.window(t, 11, t.index(" and")) for t in texts])
    y = np.array([0.0] * 150 + [1.0] * 150)
    model = secret_scan.fit_model(windows, y, np.arange(300) % 4 == 0)
    assert ((model.probabilities(windows) >= model.threshold) == (y == 1)).mean() > 0.97
    net = secret_scan.CharNet.fresh(np.random.default_rng(2))
    net.out = np.random.default_rng(3).normal(size=net.out.shape)
    # Off the kink of the rectifier, where blank places lie at first.
    net.shift = np.full(net.shift.shape, 0.05)
    some = windows[[0, 1, 200, 201]]
    target = y[[0, 1, 200, 201]]

    def loss():
        z = net.logits(some)
        return float(np.mean(np.log1p(np.exp(-z)) * target + np.log1p(np.exp(z)) * (1 - target)))

    grads = net.gradients(some, target)
    for part, grad in ((net.kernel, grads[1]), (net.out, grads[3]), (net.embed, grads[0]), (net.shift, grads[2])):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        before = part[at]
        part[at] = before + 1e-7
        up = loss()
        part[at] = before - 1e-7
        down = loss()
        part[at] = before
        assert (up - down) / 2e-7 == pytest.approx(grad[at], rel=1e-2, abs=1e-5)


def test_secrets_of_awkward_rows(spark):
    got = secret_scan.secrets(awkward(spark)).collect()
    assert len(got) == 13 and {r["spans"] for r in got if r["doc_id"] in (3, 4, 5)} == {""}
    assert [r for r in got if r["doc_id"] == 7][0]["n_access"] == 1
    assert secret_scan.secrets(empty(spark)).count() == 0


# --- language model ---


def slow_base(docs):
    train, c = 0, Counter()
    rows = [(d, (t or "").encode().lower().split()) for d, t in docs]
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows}
    for d, words in rows:
        if not held[d]:
            c.update(words)
            c[None] += 1
    n, v = sum(c.values()), len(c)
    return sorted(
        (
            (d, held[d], len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), 5))
            for d, w in rows
        ),
        key=repr,
    )


@pytest.mark.parametrize("head", [1 << 16, 40])
def test_base_scores_agree_with_brute_force(spark, head):
    docs = awkward(spark)
    got = sorted(((*tuple(r)[:5], round(r["base_score"], 5)) for r in hmm.lm_scores(docs, head_words=head, passes=1).collect()), key=repr)
    assert got == slow_base([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert hmm.lm_scores(empty(spark)).count() == 0
    alone = hmm.lm_scores(docs.where("doc_id is null")).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in alone)


def slow_scores(rows, head_words, states, passes, blocks):
    """``rows``: id, text, held out, block. The same model from lists, dictionaries and one row at a time."""
    texts = [(d, (t or "").encode().lower().split(), held, b) for d, t, held, b in rows]
    c = Counter(w for _, words, held, _ in texts if not held for w in words)
    ends = sum(not held for _, _, held, _ in texts)
    head = sorted(c, key=lambda w: (-c[w], w))[:head_words]
    number = {w: i for i, w in enumerate(head)}
    mass = [c[w] + 0.1 for w in head] + [0.1] * hmm.RARE_SIGNS + [ends + 0.1]
    for w in c:
        if w not in number:
            mass[len(head) + hmm.rare_sign(w)] += c[w] + 0.1
    base, end = np.array(mass) / sum(mass), len(mass) - 1
    symbols = [np.array([number.get(w, len(head) + hmm.rare_sign(w)) for w in words] + [end]) for _, words, _, _ in texts]
    model, counts, n = hmm.start_model(base, states), None, 0
    for _ in range(passes):
        total = hmm.Expected.zero(states, len(base))
        for block in range(blocks):
            found = hmm.Expected.zero(states, len(base))
            for row, (_, _, held, b) in zip(symbols, texts):
                if not held and b == block:
                    found.add(model, [row])
            if not found.emit.any():
                continue
            n += 1
            share = n**hmm.FADE
            for name in ("start", "step", "emit"):
                getattr(total, name)[...] += getattr(found, name)
            if counts is None:
                counts = found
            else:
                scale = counts.emit.sum() / found.emit.sum()
                counts = hmm.Expected(*[
                    (1 - share) * getattr(counts, k) + share * scale * getattr(found, k) for k in ("start", "step", "emit")
                ])
            model = counts.model(base)
    model = total.model(base)
    out = []
    for (d, words, _, _), row in zip(texts, symbols):
        score = float(hmm.forward(model, row[None, :], np.array([len(row)]))[0]) / math.log(10)
        score += sum(math.log10((c[w] + 0.1) / mass[s]) for w, s in zip(words, row) if w not in number)
        out.append((repr(d), score))
    return sorted(out)


def test_scores_agree_with_a_slow_model_however_rows_are_dealt(spark, documents):
    # With 12 and 5 words in each text, counts at the border of the head differ.
    texts = [f"a a a a b b b c c d {'x' * (i % 7)}ing y{i}ed" for i in range(30)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a lost b"), (40, None), (41, "a a b b zzz")], "doc_id long, text string")
    args = {"states": 3, "head_words": 3, "passes": 2, "blocks": 3}
    block = F.pmod(F.xxhash64(F.lit(hmm.SEED), "doc_id", hmm.text_bytes()), F.lit(3))
    rows = [tuple(r) for r in docs.select("doc_id", "text", hmm.held_out(), block).collect()]
    want = slow_scores(rows, 3, 3, 2, 3)
    for parts in (1, 4):
        got = sorted((repr(r["doc_id"]), r["score"]) for r in hmm.lm_scores(docs.repartition(parts), **args).collect())
        assert [d for d, _ in got] == [d for d, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want], atol=1e-6)


def test_the_head_is_never_empty_and_never_too_large(spark):
    counts = spark.range(50).select(F.col("id").cast("string").cast("binary").alias("word"), F.lit(7).cast("long").alias("c"))
    assert 20 <= len(hmm._head(counts, 40)) <= 40
    assert len(hmm._head(counts, 50)) == 50
    mixed = counts.withColumn("c", F.col("c") + F.when(F.col("word") == F.lit("3").cast("binary"), 5).otherwise(0))
    assert bytes(hmm._head(mixed, 10)[0]["word"]) == b"3"


def test_the_model_beats_the_unigram_on_held_out_documents(spark, documents):
    rows = hmm.lm_scores(documents).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 0.1 * sum(r["n_tokens"] for r in rows)


def small_model(rng, states=3, symbols=5):
    p = lambda *s: rng.dirichlet(np.ones(s[-1]), s[:-1])
    return hmm.Model(p(states), p(states, states), p(states, symbols).T)


def paths(model, row):
    for states in itertools.product(range(len(model.start)), repeat=len(row)):
        p = model.start[states[0]] * model.emit[row[0], states[0]]
        for t in range(1, len(row)):
            p *= model.step[states[t - 1], states[t]] * model.emit[row[t], states[t]]
        yield states, p


def test_forward_and_expected_counts_agree_with_all_paths():
    rng = np.random.default_rng(4)
    model = small_model(rng)
    rows = [rng.integers(0, 5, n) for n in (1, 4, 2, 6, 4)]
    want = hmm.Expected.zero(3, 5)
    for row in rows:
        total = sum(p for _, p in paths(model, row))
        for states, p in paths(model, row):
            want.start[states[0]] += p / total
            for t, s in enumerate(states):
                want.emit[row[t], s] += p / total
                if t:
                    want.step[states[t - 1], s] += p / total
    got = hmm.Expected.zero(3, 5)
    got.add(model, rows)
    for name in ("start", "step", "emit"):
        assert np.allclose(getattr(got, name), getattr(want, name)), name
    for at, symbols, lengths in hmm.padded(rows):
        scores = hmm.forward(model, symbols, lengths)
        assert np.allclose(scores, [math.log(sum(p for _, p in paths(model, rows[i]))) for i in at])


def test_baum_welch_never_lowers_the_likelihood():
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(60):
        rows.append(rng.integers(0, 5, rng.integers(3, 30)))
    base = np.full(5, 0.2)
    model, last = small_model(rng), -np.inf
    for _ in range(8):
        total = sum(hmm.forward(model, s, n).sum() for _, s, n in hmm.padded(rows))
        assert total > last - 0.5
        last, counts = total, hmm.Expected.zero(3, 5)
        counts.add(model, rows)
        model = counts.model(base)
