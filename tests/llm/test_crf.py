import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import ODD
from tramline.llm import crf
from tramline.llm.textnum import Words

EN, DE = "the house and the garden with three little birds", "der kleine vogel und das haus mit dem garten"
LINES = [(EN, 0), (DE, 1), ("and then the birds with the house", 0), ("und dann der vogel mit dem haus", 1), ("three birds", 0), ("drei vogel", 1)] * 20


@pytest.fixture(scope="module")
def model():
    return crf.train(LINES, ["en", "de", crf.OTHER], epochs=6)


def brute(scores, transitions):
    """Marginals by listing all label sequences."""
    n, k = scores.shape
    total = np.zeros((n, k))
    for path in np.ndindex(*[k] * n):
        weight = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, y in enumerate(path):
            total[i, y] += weight
    return total / total.sum(axis=1, keepdims=True)


def test_marginals_against_all_paths():
    random = np.random.default_rng(1)
    scores, move = random.normal(size=(6, 3)).astype(np.float32), random.normal(size=(3, 3)).astype(np.float32)
    got = crf.marginals(scores, move, np.array([0, 4]))[0]
    assert np.allclose(got[:4], brute(scores[:4], move), atol=1e-4)
    assert np.allclose(got[4:], brute(scores[4:], move), atol=1e-4)


def test_blocks_change_nothing():
    random = np.random.default_rng(2)
    scores, move = random.normal(size=(700, 4)).astype(np.float32), random.normal(size=(4, 4)).astype(np.float32)
    first = np.array([0, 1, 130, 600])
    assert np.allclose(crf.marginals(scores, move, first, block=16)[0], crf.marginals(scores, move, first, block=10**6)[0], atol=1e-4)


def test_switches_within_a_line(model):
    words, p, _ = crf.label(pa.array(["the little birds der kleine vogel und das haus"]), model)
    labels = [model.labels[i] for i in p.argmax(axis=1)]
    assert labels[:3] == ["en"] * 3 and labels[3:] == ["de"] * 6


def test_held_out_accuracy(model):
    held = [("the garden and birds", 0), ("das haus und vogel", 1), ("with little birds", 0), ("mit dem vogel", 1)]
    words, p, _ = crf.label(pa.array([t for t, _ in held]), model)
    assert crf.decide(words, p, model)[0].tolist() == [y for _, y in held]


def test_digits_are_no_language(model):
    words, p, _ = crf.label(pa.array(["4711 0815 a1b2", "the birds"]), model)
    assert crf.decide(words, p, model)[2].tolist() == [False, True]


def test_odd_rows(docs):
    rows = {(r.doc_id, r.n_words): r for r in crf.labelled(docs(ODD)).collect()}
    assert rows[(1, 0)].language is None and not rows[(1, 0)].keep and rows[(1, 0)].spans == []
    assert not rows[(2, 0)].keep and not rows[(4, 0)].keep
    assert rows[(None, 6)].keep and rows[(3, 6)].keep
    assert rows[(6, 3000)].spans[-1].end == 3000
    assert len(crf.labelled(docs(ODD)).collect()) == len(ODD)


def test_kept_rows_are_whole(docs):
    own = docs(ODD)
    kept = crf.kept(own)
    assert kept.schema == own.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "5", "6", "7", "None"]


def test_empty_and_unlabelled(docs):
    assert crf.labelled(docs([])).count() == 0
    rows = crf.labelled(docs([(1, "some words", None), (2, None, None)])).collect()
    assert [(r.doc_id, r.keep, r.language) for r in sorted(rows)] == [(1, True, None), (2, False, None)]


def test_chains_break_at_lines():
    words = Words(pa.array(["a b\nc", "", "d"]))
    assert crf.chains(words).tolist() == [0, 2, 3]


def test_a_stray_word_keeps_no_codes(model):
    codes = " ".join(f"{i * 7919:x}9" for i in range(200))
    words, p, _ = crf.label(pa.array([codes + " house", codes + "\nthe garden\n" + codes, EN + " 4711 0815"]), model)
    lang, share, keep, _ = crf.decide(words, p, model)
    assert keep.tolist() == [False, False, True] and lang.tolist() == [-1, -1, 0] and share[:2].tolist() == [0, 0]


def test_rows_marked_as_no_language_are_learnt(docs):
    r = np.random.default_rng(3)
    junk = [" ".join("".join(r.choice(list("qxzjkvw"), r.integers(3, 9))) for _ in range(12)) for _ in range(60)]
    english = [" ".join(r.permutation(EN.split())) for _ in range(40)]
    rows = [*((i, t, "und") for i, t in enumerate(junk[:40])), *((100 + i, t, "en") for i, t in enumerate(english)), *((200 + i, t, None) for i, t in enumerate(junk[40:]))]
    got = {r.doc_id: (r.language, r.keep) for r in crf.labelled(docs(rows)).collect()}
    assert got == {i: ("en", True) if lang == "en" else (None, False) for i, _, lang in rows}
    assert sorted(r.doc_id for r in crf.kept(docs(rows)).select("doc_id").collect()) == list(range(100, 140))
    only = crf.labelled(docs([(1, junk[0], "und")])).first()
    assert only.keep and only.language is None
