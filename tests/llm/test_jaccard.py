import corpus_pipeline
from docloom.llm.jaccard import drop_similar, similar_documents
from docloom.llm.simhash import drop_near_duplicates
from tests.llm.rows import awkward, empty, plain

SF_DIR = "/root/testdata/sf0.001"


def slow_components(docs):
    """Smallest id per document by comparing all pairs."""
    sets = {}
    for d, t in docs:
        words = (t or "").encode().lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b])
            if a < b and root[a] != root[b] and common + 1e-9 >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def edited():
    """Texts of 300 words, and copies with 1 to 9 single words changed: similarities from 0.97 to 0.74."""
    docs = []
    for i in range(12):
        words = [f"w{(i * 31 + k * k * k) % 1009}x{k}" for k in range(300)]
        for edits in range(10):
            copy = list(words)
            for e in range(edits):
                copy[20 + 28 * e] = f"new{i}-{edits}-{e}"
            docs.append((i * 10 + edits, " ".join(copy)))
    return docs


def test_edited_copies_agree_with_all_pairs(spark):
    docs = edited()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar_documents(df).collect()} == slow_components(docs)


def test_stage_drops_a_copy_of_similarity_0_84(spark):
    words = [f"w{k}" for k in range(300)]
    copy = [f"new{k}" if k % 55 == 20 else w for k, w in enumerate(words)]
    docs = [(1, " ".join(words)), (2, " ".join(copy)), (3, "something else altogether, and longer")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF_DIR).collect()) == [1, 3]


def test_real_documents_agree_with_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(docs).collect()}
    assert got == slow_components([tuple(r) for r in docs.collect()])


def crowds():
    """Two families of 60 near copies below 0.8 of each other, joined by one document each way only, and loners."""
    base = [f"b{k}" for k in range(200)]
    other = [f"o{k}" if k % 8 == 3 else w for k, w in enumerate(base)]
    docs = []
    for i in range(60):
        docs.append((i, " ".join(f"e{i}" if k == 3 * i + 1 else w for k, w in enumerate(base))))
        docs.append((100 + i, " ".join(f"f{i}" if k == 3 * i + 2 else w for k, w in enumerate(other))))
    # A chain of edits that leads from the first family away from it.
    link = [f"g{k}" if 150 <= k < 160 else w for k, w in enumerate(base)]
    far = [f"h{k}" if 165 <= k < 175 else w for k, w in enumerate(link)]
    docs += [(200, " ".join(link)), (201, " ".join(far)), (202, " ".join(far[:170])), (203, "alone and short"), (204, "")]
    return docs


def test_groups_that_meet_in_large_buckets_agree_with_all_pairs(spark):
    docs = crowds()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = slow_components(docs)
    assert len(set(expected.values())) > 3
    for few in (32, 4):
        assert {r["doc_id"]: r["component_id"] for r in similar_documents(df, few=few).collect()} == expected


def bridged(n):
    """Two families of ``n`` near copies, linked by one pair only, whose common shingles all of both families have."""
    core = [f"d{k}" for k in range(500)]
    docs = []
    for first, name in ((0, "p"), (1000, "q")):
        own = [f"{name}{k}" for k in range(100)]
        docs += [(first + i, " ".join(core + own + [f"{name}{i}u{k}" for k in range(25)])) for i in range(n)]
        docs.append((first + n, " ".join(core + own[:50])))
    return docs


def test_groups_linked_by_shingles_that_many_share_agree_with_all_pairs(spark):
    docs = bridged(60)
    expected = slow_components(docs)
    assert set(expected.values()) == {0}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for few in (32, 4):
        assert {r["doc_id"]: r["component_id"] for r in similar_documents(df, few=few).collect()} == expected


def test_tiles_of_a_crowd_link_the_groups_that_all_pairs_link(spark, monkeypatch):
    monkeypatch.setattr("docloom.llm.jaccard.TILE", 16)
    docs = bridged(60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar_documents(df, few=4).collect()} == slow_components(docs)


SEVEN = [(1, "c"), (None, "c"), (None, "u"), (5, "v"), (5, "c"), (7, "s"), (7, "s")]


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    words = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(d, f"{t} {words}" if t == "c" else " ".join(f"{t}{k}" for k in range(60)), i) for i, (d, t) in enumerate(SEVEN)], "doc_id long, text string, extra int")
    for kept in (drop_similar(docs), drop_near_duplicates(docs), corpus_pipeline.near_duplicates(spark, docs, SF_DIR)):
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["text"][:2].rstrip("0123456789 ")) for r in kept.collect()) == [(0, "u"), (1, "c"), (5, "v"), (7, "s")]


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = slow_components([(i, t) for i, (_, t) in enumerate(rows)])
    got = plain(similar_documents(docs))
    least = {g: min((rows[i][0] for i in groups if groups[i] == g and rows[i][0] is not None), default=None) for g in groups.values()}
    assert got == sorted(((rows[i][0], least[g]) for i, g in groups.items()), key=repr)
    # One row of each group stays, with all its columns.
    kept = drop_similar(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(groups.values()))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(d for d in least.values() if d is not None)
    assert similar_documents(empty(spark)).count() == 0 and drop_similar(empty(spark)).count() == 0
