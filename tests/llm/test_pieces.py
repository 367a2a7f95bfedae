import math
import random

import pyarrow as pa
import pytest
import sentencepiece

from docloom.llm.piece_encoding import PieceEncoder, decode, encode, round_trip, small_batches
from docloom.llm.pieces import load_model
from docloom.llm.queries import PIECE_MODEL
from docloom.llm.token_counts import CountingTrie, token_counts
from tests.llm.rows import LONG, awkward, empty


@pytest.fixture(scope="module")
def model():
    return load_model(PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def texts():
    rnd = random.Random(4)
    marks = "aaabbeeinrst  \n\t.,!?éüñ😀▁日本здесь019AB_=-/"
    out = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 70))) for _ in range(400)]
    out += ["", " ", "   ", "a" * 5000, "ab" * 3000 + "é" * 300, "x\x00y", "\r\n", " lead", "trail  ", LONG]
    return out + [t.replace(" ", "") * 30 for t in out[:20]]


def test_ids_are_those_of_the_library(model, library):
    encoder = PieceEncoder(model)
    for text in texts():
        assert encoder.encode(text) == library.encode(text), text[:60]
    assert [PieceEncoder(model).encode_all(texts()) for _ in range(1)][0] == library.encode(texts())


def test_decoding_is_that_of_the_library_and_exact(model, library):
    encoder = PieceEncoder(model)
    for text in texts():
        ids = encoder.encode(text)
        assert model.decode(ids) == library.decode(ids)
        assert model.decode(ids) == text.replace("▁", " ")
    # Bytes that are no text become replacement characters.
    assert "�" in model.decode([model.bytes_from[0xE9], model.bytes_from[0x41]])


def test_feeding_in_parts_changes_nothing_and_holds_little(model, library):
    for text in ("thequickbrownfox" * 400, "a" * 3000, "zażółć" * 200):
        encoder, normal = PieceEncoder(model), model.normalise(text)
        from docloom.llm.piece_encoding import StreamingViterbi

        search, ids, held = StreamingViterbi(model), [], 0
        for i in range(0, len(normal), 7):
            ids += search.feed(normal[i : i + 7])
            held = max(held, len(search.text))
        assert ids + search.finish() == library.encode(text) == list(encoder.stream([normal]))
        assert held < 400


def test_counts_share_prefixes_and_survive_a_full_trie(model, library):
    trie, small = CountingTrie(model), CountingTrie(model, max_nodes=50)
    for text in texts():
        n = len(library.encode(text))
        assert trie.count_text(text)[1] == n == small.count_text(text)[1]
    assert len(trie.piece) < sum(map(len, trie)) + 1


def test_a_worker_holds_the_words_of_one_megabyte():
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i} " * 5000 for i in range(1000, 1160)])], names=["text"])
    parts = list(small_batches(iter([batch])))
    assert max(p.column("text").nbytes for p in parts) <= 1 << 20
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_a_unigram_vocabulary_gets_the_best_sum(tmp_path, model):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(PIECE_MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, piece in enumerate(proto.pieces):
        if piece.type == 1:
            piece.score = -math.log(i + 2) - 0.001 * (i * 7919 % 1000)
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(proto.SerializeToString())
    own, library = load_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    encoder, trie = PieceEncoder(own), CountingTrie(own)
    total = lambda ids: sum(own.scores[i] if i not in own.byte_of else 0.0 for i in ids)
    for text in texts()[:200]:
        if "▁" in text:
            continue
        ids = encoder.encode(text)
        assert total(ids) == pytest.approx(total(library.encode(text)), abs=1e-3) and own.decode(ids) == text
        assert trie.count_text(text)[1] == len(ids)


def test_tables(spark, model, library):
    docs = awkward(spark)
    rows = round_trip(docs, model).collect()
    assert len(rows) == 13
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["ids"] == [] and by_id[4]["ids"] == [] and by_id[3]["exact"] and by_id[6]["ids"] == library.encode(LONG)
    # A space mark in a text comes back as a space, as in the library.
    assert not by_id[7]["exact"] and all(r["exact"] for i, r in by_id.items() if i != 7)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, model).collect()}
    assert all(counts[i] == r["n_ids"] for i, r in by_id.items())
    back = decode(encode(docs.where("doc_id = 10"), model), model).first()
    assert back["text"] == docs.where("doc_id = 10").first()["text"]
    assert round_trip(empty(spark), model).count() == 0 and token_counts(empty(spark), model).count() == 0
