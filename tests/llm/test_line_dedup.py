from docloom.llm.line_dedup import line_dedup
from tests.llm.rows import awkward, empty


def brute(docs, size=3):
    """docs: list of (doc_id, text), one row per document."""
    seen, out = {}, {}
    order = sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is not None, d[0]))
    for doc_id, text in order:
        lines, gone = text.split("\n"), set()
        for i in range(max(0, len(lines) - size) + 1):
            w = tuple(lines[i : i + size])
            if "".join(w).strip(" ") == "":
                continue
            if w in seen:
                gone |= set(range(i, min(i + size, len(lines))))
            else:
                seen[w] = 1
        out[doc_id] = ("\n".join(line for i, line in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_agrees_with_brute_force(spark):
    docs = [(i, "\n".join(f"line {(i * k) % 5}" for k in range(i % 9))) for i in range(60)]
    docs += [(100, "a\nb\nc\nd"), (101, "x\na\nb\nc\ny"), (102, "b\nc\nd\ne"), (103, "q\nq\nq\nq\nq"), (104, "\n\n\n\n"), (105, "one"), (106, "one")]
    got = line_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()} == brute(docs)


def test_every_removed_line_stays_somewhere(spark):
    docs = [(i, "\n".join(f"l{(i + k) % 7}" for k in range(6))) for i in range(40)]
    left = [r["text"] for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert {x for _, t in docs for x in t.split("\n")} == {x for t in left for x in t.split("\n") if x}


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = line_dedup(docs)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_removed"} and got.count() == docs.count()
    rows = {(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()}
    # The copy of document 1 is emptied; repeated rows of 6 and 9 are one document each and stay.
    assert (2, "", 3, 3) in rows and (3, None, 0, 0) in rows and (4, "", 1, 0) in rows and (9, "short", 1, 0) in rows
    assert (5, "   \n\n  ", 3, 0) in rows and (None, None, 0, 0) in rows
    assert line_dedup(empty(spark)).count() == 0
    assert line_dedup(got).columns.count("n_lines") == 1


def test_very_many_lines(spark):
    text = "\n".join(f"row {i % 1000}" for i in range(30_000))
    row = line_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["text"] == "\n".join(f"row {i}" for i in range(1000)) and row["n_removed"] == 29_000
