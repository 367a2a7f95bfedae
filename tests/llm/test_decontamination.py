import re

import pytest

from docloom.llm.common import sha256_hex
from docloom.llm.decontamination import contamination, decontaminate
from tests.llm.rows import LONG, awkward, empty, plain

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            v = words(body)
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[k : k + n]:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), sha256_hex(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(10, "quick brown FOX jumps over the lazy dog and runs away!"), (9, "third line"), (2, None), (3, "..."), (4, "short"), (5, "no such words here")]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_contamination_agrees_with_brute_force_in_any_number_of_blocks(spark, items, block_bytes):
    docs = awkward(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] != LONG]
    got = contamination(docs.where("text is null or length(text) < 5000"), items, block_bytes=block_bytes)
    assert plain(got) == brute(pairs, ITEMS)


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_spans_and_documents_are_removed(spark, items, block_bytes):
    docs = awkward(spark)
    kept = decontaminate(docs, items, block_bytes=block_bytes)
    hit = {r["doc_id"] for r in contamination(docs, items).where("contaminated").collect()}
    assert hit == {1, 2, 9} and kept.schema == docs.schema
    assert plain(kept) == plain(docs.where("doc_id is null or doc_id not in (1, 2, 9)"))
    cut = decontaminate(docs, items, remove="spans", block_bytes=block_bytes)
    assert cut.schema == docs.schema and cut.count() == docs.count()
    by_id = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert by_id[1] == "The  from the barn.\nsecond line\n" and by_id[9] == "" and by_id[3] is None
    assert by_id[6] == LONG and by_id[7].endswith("\u0000 end")


def test_empty_tables(spark, items):
    assert contamination(empty(spark), items).count() == 0
    got = contamination(awkward(spark), items.where("false")).collect()
    assert len(got) == 13 and not any(r["contaminated"] for r in got)
    with pytest.raises(ValueError):
        decontaminate(awkward(spark), items, remove="words")
