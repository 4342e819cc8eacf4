import hashlib
import random

import numpy as np

from kalangu.llm import pieces, queries


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_agenda_equals_library_on_hard_texts():
    p, lib, rng = pieces.Pieces(pieces.default_model()), library(), random.Random(1)
    some = "aAbéß ▁  \n\t.,!?\"'’“”()[]{}\r0123中́\x00 the ing <s>"
    texts = ["", " ", "a" * 5_000, " " * 70, *("".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(4_000))]
    real = [np.array(x, "<u4").tobytes() for x in lib.encode(texts, add_bos=True, add_eos=True)]
    assert p.encode(texts, 1) == real
    assert p.decode(real) == lib.decode([np.frombuffer(x, "<u4").tolist() for x in real])


def test_matrix_equals_heap():
    p, rng = pieces.Pieces(pieces.default_model()), random.Random(2)
    spans = ["".join(rng.choice("▁abcdefghijklmnoprstuéß中") for _ in range(rng.randint(1, 31))) for _ in range(2_000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in p.merge_short(spans)] == [p.merge(s) for s in spans]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    p = pieces.Pieces(pieces.default_model())
    first = p.encode(["one two three four five six seven eight nine ten eleven twelve"], 1)
    p.encode(["other words"], 1)
    assert len(p.memory) <= 10
    assert p.encode(["one two three four five six seven eight nine ten eleven twelve"], 1) == first


def test_difference_raises(monkeypatch):
    p = pieces.Pieces(pieces.default_model())
    p.memory["▁hello"] = b"\x05\0\0\0"
    try:
        p.encode(["hello"], 1)
    except AssertionError:
        return
    raise AssertionError("a wrong encoding went through")


def test_query_equals_library(spark, docs):
    lib = library()
    got = {r.doc_id: r for r in queries.op9_pieces(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        ids = lib.encode(r.text, add_bos=True, add_eos=True)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_edges(edge, nothing):
    lib = library()
    for r in pieces.encode_and_decode(edge).collect():
        want = lib.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.ids == want and r.decoded == lib.decode(want) and r["a.b"] in (4, None)
    assert pieces.encode_and_decode(edge, ids="spans").columns == [*edge.columns, "decoded"]
    assert pieces.encode_and_decode(nothing, packed=True).count() == 0
