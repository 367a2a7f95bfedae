import re
import zlib
from collections import Counter
from itertools import product

from docloom.llm.spelling import near_pairs, roots, spelling_forms, spelling_variants
from tests.llm.rows import awkward, empty


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def slow_words(docs):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def slow_forms(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_documents_agree_with_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert result(spelling_variants(docs)) == slow_forms(slow_words([tuple(r) for r in docs.collect()]))


def crowd():
    """Words that share long beginnings and ends, words of one and two code points, letters of two bytes."""
    words = ["inter" + "".join(p) + "ation" for p in product("abcé", repeat=4)]
    words += ["inter" + "".join(p) + "ation" for p in product("abc", repeat=3)]
    words += ["".join(p) for p in product("xyz", repeat=2)] + ["x", "y", "é"] + ["a" * n for n in range(1, 40)]
    return {w: 1 + (i * i * 7919) % 1009 for i, w in enumerate(words)}


def test_crowded_chunks_are_divided_until_they_are_small(spark):
    words = crowd()
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    expected = {tuple(sorted((a, b))) for a in words for b in words if one_edit(a, b)}
    for chunks, grams in ((32, 2048), (2, 2), (10**6, 10**6)):
        rows = near_pairs(df, chunks, grams).collect()
        assert {tuple(sorted((r["a"], r["b"]))) for r in rows} == expected and len(rows) == len(expected)
    assert result(spelling_forms(df)) == slow_forms(words)


def test_chains_end_at_the_last_form(spark):
    chain = [(f"w{i}", f"w{i + 1}" if i < 40 else None) for i in range(41)]
    got = {r["word"]: r["root"] for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w40" for i in range(41)}


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "'k' as key", "1 as n", "'r' as run")
    more = spark.createDataFrame([(None, "Straße Straßen straße straßen STRASSE É é " * 5), (20, "A" * 9000 + " " + "A" * 9000), (21, "a" * 9000)], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    expected = slow_forms(slow_words([(r["doc_id"], r["text"]) for r in both.collect()]))
    assert result(spelling_variants(both)) == expected and "a" * 9000 in expected
    assert spelling_variants(empty(spark)).count() == 0
