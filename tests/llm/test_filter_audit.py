from itertools import permutations

import numpy as np
import re

from docloom.llm.filter_audit import audit_masks, fail_masks, filter_audit, removal_steps, text_fails
from tests.llm.rows import awkward, empty

LABELS = "doc_id long, quality int, toxic int"


def slow_audit(docs, labels):
    """Every order replayed document by document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for d, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [e for e, other, _ in docs if (other or "") == t and e is not None]
        f = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": d is not None and any(e < d for e in same),
        }
        fails.append((lang or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [row for row in fails if row[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = len(left)
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                assert before - len(gone) == len(left)
                shapley[f] += len(gone)
                alone = sum(r[1] == {f} for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def result(df):
    return {(r[0], r[1], r[2]): list(r[3:]) for r in df.collect()}


def documents():
    long_ = " ".join(f"w{i}" for i in range(220))
    texts = [long_, long_, "Same Same #", "Same Same #", None, "", "x " * 300, "A B C", long_ + " é$", " \t\n", "X" * 400, long_]
    rows = [(i if i != 7 else None, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts)]
    return rows + [(3, "Same Same #", "en"), (3, "other", "en"), (3, "Same Same #", "en"), (None, long_, "de")]


def test_audit_agrees_with_a_replay_of_every_document(spark):
    docs = documents()
    labels = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (3, None, 1), (3, 1, None), (None, 1, 1), (99, 1, 1), (6, 1, 0)]
    got = filter_audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS))
    expected = slow_audit(docs, labels)
    assert result(got) == expected and len(expected) == 3 * 600


def test_steps_are_the_first_failed_filter():
    orders = np.array(list(permutations(range(4))))
    steps = removal_steps(np.arange(16), orders)
    for mask in range(16):
        for o, order in enumerate(orders):
            first = [s for s, f in enumerate(order) if mask >> f & 1]
            assert steps[mask, o] == (first[0] if first else 4)


def test_other_filter_names(spark):
    counts = spark.createDataFrame([("p", 0, 5, 0, 0), ("p", 3, 2, 1, 0)], "part string, fails int, n long, n_good long, n_toxic long")
    rows = {(r["filter_order"], r["step"]): r["removed"] for r in audit_masks(counts, "XY").collect()}
    assert rows == {("XY", 1): 2, ("XY", 2): 0, ("YX", 1): 2, ("YX", 2): 0}


def test_code_points_and_bytes():
    # 3 capitals of 100 code points pass, of 99 they fail; the marks take two bytes each.
    assert text_fails(("ABC" + "é" * 97).encode()) & 4 == 0 and text_fails(("ABC" + "é" * 96).encode()) & 4


def test_awkward_rows(spark):
    docs = awkward(spark).withColumnRenamed("row", "lang").selectExpr("*", "1 as n", "'x' as part", "2L as h1")
    labels = spark.createDataFrame([(1, 1, 1), (1, None, None)], LABELS)
    plain = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert result(filter_audit(docs, labels)) == slow_audit(plain, [tuple(r) for r in labels.collect()])
    assert filter_audit(empty(spark).withColumnRenamed("row", "lang"), labels).count() == 0
    assert filter_audit(docs, labels.limit(0)).count() == 600


def test_copies_do_not_meet_in_one_key(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'the same text' as text", "'en' as lang")
    counts = fail_masks(docs, spark.createDataFrame([], LABELS)).collect()
    assert sorted((r["fails"], r["n"]) for r in counts) == [(1, 1), (17, 4999)]
