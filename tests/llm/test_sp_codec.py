import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import ODD
from tramline.llm import sp_codec

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=sp_codec.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return sp_codec.Vocabulary(sp_codec.MODEL)


def ids_of(texts, vocabulary):
    ids, first = sp_codec.encode(pa.array(texts, pa.string()), vocabulary)
    return [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]


TEXTS = ["", "a", "Hello world", "  two  spaces ", "línea\nnueva", "漢字 and \U0001f600\U0001f601", "aaaaaaaaaaaaaaaa", "the " * 50, "Ümläute straße", "0123456789" * 100, "\t\x00\x01", "x" * 1000]


def test_equals_the_library(vocabulary):
    assert ids_of(TEXTS, vocabulary) == LIBRARY.encode(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="▁"), max_size=60), max_size=6))
def test_round_trip(texts):
    vocabulary = sp_codec.Vocabulary(sp_codec.MODEL) if not hasattr(test_round_trip, "v") else test_round_trip.v
    test_round_trip.v = vocabulary
    ids, first = sp_codec.encode(pa.array(texts, pa.string()), vocabulary)
    assert sp_codec.decode(ids, first, vocabulary).to_pylist() == texts


def test_every_occurrence_is_an_edge(vocabulary):
    text = np.array([ord(c) for c in "▁the▁then"] + [sp_codec._SEPARATOR], np.uint32)
    table = sp_codec.edges(text, vocabulary)
    for i in range(9):
        for k in range(2, min(9 - i, vocabulary.deepest) + 1):
            piece = "".join(map(chr, text[i : i + k]))
            known = LIBRARY.piece_to_id(piece)
            assert (table[i, k - 1] >= 0) == (known != LIBRARY.unk_id()), piece


def test_long_segments_use_the_heap(vocabulary):
    text = "ab" * 900 + "é" * 50
    assert ids_of([text], vocabulary) == [LIBRARY.encode(text)]


def test_odd_rows(docs):
    rows = sp_codec.encoded(docs(ODD)).collect()
    assert len(rows) == len(ODD) and all(r.decoded_ok for r in rows)
    assert {r.doc_id: r.ids for r in rows}[1] == [] and {r.doc_id: r.n_tokens for r in rows}[2] == 0
    assert {r.doc_id: r.ids for r in rows}[6] == LIBRARY.encode("x " * 3000)
    assert sp_codec.encoded(docs([])).count() == 0


def test_decoded_table(spark, docs):
    rows = [(1, "Hello there"), (2, None), (3, "")]
    back = sp_codec.decoded(sp_codec.encoded(docs(rows)))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, "Hello there"), (2, ""), (3, "")]
    assert sp_codec.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""


def test_word_mark_in_text(docs):
    row = sp_codec.encoded(docs([(1, "a▁b")])).first()
    assert row.ids == LIBRARY.encode("a▁b") and row.decoded_ok


def test_long_texts_equal_the_library(vocabulary):
    rng = np.random.Generator(np.random.PCG64(5))
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz   é漢"))
    long = "".join(letters[rng.integers(0, len(letters), 300_000)])
    unbroken = "".join(letters[:20][rng.integers(0, 20, 30_000)])
    for text in (long, unbroken, " " * 5000 + long[:9000], "漢" * 20_000, "-" * 30_000):
        ids, first = sp_codec.encode(pa.array([None, "a b", text, "", text[:70]]), vocabulary, most=10_000)
        got = [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]
        assert got == [[], LIBRARY.encode("a b"), LIBRARY.encode(text), [], LIBRARY.encode(text[:70])]


def test_six_million_characters(vocabulary):
    rng = np.random.Generator(np.random.PCG64(6))
    text = " ".join(f"w{x:x}" for x in rng.integers(0, 1 << 40, 520_000).tolist())
    assert len(text) > 6_000_000
    assert ids_of([text], vocabulary) == [LIBRARY.encode(text)]
