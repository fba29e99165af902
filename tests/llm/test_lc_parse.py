import random

import numpy as np
import pyarrow as pa

from tests.llm.conftest import ODD
from tramline.llm import lc_parse


def signatures(texts, level=lc_parse.LEVEL):
    root, height, flat, first = lc_parse.parse(pa.array(texts), level)
    return root, height, [flat[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]


def some(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("abcdefghij klmnop") for _ in range(n))


def test_labels_against_plain_coin_tossing():
    r = random.Random(1)
    names = [r.randrange(1, 1 << 62)]
    while len(names) < 200:
        x = r.randrange(1, 1 << 62) if r.random() < 0.7 else names[-1] ^ (1 << r.randrange(62))
        if x != names[-1]:
            names.append(x)
    got = lc_parse.toss(np.array(names, np.uint64), np.array([0])).tolist()
    label, bits = names, 64
    while True:
        nxt = [2 * 0 + (label[0] & 1)]
        for a, b in zip(label, label[1:], strict=False):
            low = ((a ^ b) & -(a ^ b)).bit_length() - 1
            nxt.append(2 * low + ((b >> low) & 1))
        label = nxt
        if bits <= 3:
            break
        bits = (2 * bits - 1).bit_length()
    assert got == label and max(got) < 6 and all(a != b for a, b in zip(got, got[1:], strict=False))


def test_equal_substrings_share_interior_signatures_at_any_offset():
    shared = some(4000, 2)
    for offset in (0, 1, 7, 100, 333):
        _, _, (a, b) = signatures([some(offset, 3) + shared + some(50, 4), some(500 + offset, 5) + shared])
        common = set(a) & set(b)
        assert len(common) >= 0.75 * min(len(a), len(b))


def test_different_texts_share_nothing():
    _, _, (a, b) = signatures([some(3000, 6), some(3000, 7)])
    assert not set(a) & set(b)


def test_equal_texts_and_runs():
    root, _, sig = signatures(["x" * 5000, "x" * 5000, "x" * 5001, "ab" * 4000, "ab" * 4000])
    assert root[0] == root[1] != root[2] and root[3] == root[4] and sig[3] == sig[4]


def test_rows_of_a_batch_do_not_matter():
    texts = [some(n, n) for n in (0, 1, 2, 50, 900)]
    whole = signatures(texts)
    for i, t in enumerate(texts):
        root, height, sig = signatures([t])
        assert (root[0], height[0], sig[0]) == (whole[0][i], whole[1][i], whole[2][i])


def test_odd_rows(docs):
    rows = lc_parse.fingerprints(docs(ODD)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.levels, tuple(r.signatures)))
    assert len(rows) == len(ODD) and by[1] == by[2] == [(0, 0, ())] and by[3][0] == by[3][1] == by[None][0]
    assert lc_parse.fingerprints(docs([])).collect() == []
