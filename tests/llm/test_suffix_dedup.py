import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import ODD
from tramline.llm import suffix_dedup as sd


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=200))
def test_suffix_array_and_prefixes(symbols):
    text = np.array([*symbols, 9])
    sa, rank = sd.suffix_array(text)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert rank[sa].tolist() == list(range(len(text)))
    lcp = sd.common_prefixes(text, sa, rank, lanes=7)
    for r in range(1, len(text)):
        a, b, n = text[sa[r - 1] :], text[sa[r] :], 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[r] == n


def brute(rows, least):
    """Spans of each distinct (doc_id, text)."""
    seen = {}
    split = [(r[0], r[1], (r[1] or "").lower().split()) for r in rows]
    for _, _, w in split:
        for i in range(len(w) - least + 1):
            seen[tuple(w[i : i + least])] = seen.get(tuple(w[i : i + least]), 0) + 1
    out = set()
    for doc_id, text, w in split:
        marked = sorted(i for i in range(len(w) - least + 1) if seen[tuple(w[i : i + least])] > 1)
        k = 0
        while k < len(marked):
            begin = end = marked[k]
            while k < len(marked) and marked[k] <= end + least:
                end = marked[k]
                k += 1
            out.add((doc_id, text, begin, end + least))
    return sorted((d, b, e) for d, _, b, e in out)


@pytest.mark.parametrize("size,often", [(400, sd.OFTEN), (3000, sd.OFTEN), (1 << 20, sd.OFTEN), (400, 2), (3000, 1)])
def test_spans_against_brute_force_in_many_shards(docs, size, often, monkeypatch):
    monkeypatch.setattr(sd, "SAMPLED", 1)
    r = random.Random(4)
    passages = [" ".join(f"p{k}_{i}" for i in range(12 + k * 5)) for k in range(6)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            parts.append(" ".join(f"u{d}_{r.randrange(10**6)}" for _ in range(r.randrange(0, 30))))
            if r.random() < 0.5:
                parts.append(r.choice(passages))
        rows.append((d, " ".join(parts)))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (101, "again and " * 30)]
    got = sorted((x.doc_id, x.begin, x.end) for x in sd.repeated(docs(rows).repartition(3), least=10, gram=5, size=size, often=often).collect())
    assert got == brute(rows, 10) and len(got) > 20


def test_odd_rows(docs):
    got = sorted((str(r.doc_id), r.begin, r.end) for r in sd.repeated(docs(ODD), least=5, gram=3).collect())
    assert got == [("3", 0, 6), ("6", 0, 3000), ("None", 0, 6)]
    assert sd.repeated(docs([])).collect() == []


def test_clean_texts_are_left_alone(docs):
    assert sd.repeated(docs([(i, " ".join(f"{i}_{k}" for k in range(200))) for i in range(20)])).collect() == []


def test_merging_counts_names():
    a, b = np.array([1, 4, 7]), np.array([2, 4, 4])
    assert [m.tolist() for m in sd.merged([a, b])] == [[False, True, False], [False, True, True]]


def test_shard_sends_one_of_each_kind():
    text = " ".join(f"w{i}" for i in range(60))
    runs, (row, _, _) = sd.shard(pa.array([text, text, text]), least=50, gram=24)
    assert runs[0].tolist() == [0, 1, 2] and len(set(row.tolist())) == 1


def test_a_hot_gram_and_a_hot_row(docs, monkeypatch):
    """A passage of 30 words in every text, followed by words of its own, and one row that is there many times."""
    monkeypatch.setattr(sd, "SAMPLED", 1)
    boiler = " ".join(f"b{i}" for i in range(30))
    rows = [(d, f"u{d} {boiler} " + " ".join(f"v{d % 90}_{k}" for k in range(25))) for d in range(150)] + [(999, boiler + " x y z " + boiler)] * 40
    got = sorted((x.doc_id, x.begin, x.end) for x in sd.repeated(docs(rows).repartition(4), least=40, gram=12, size=2000, often=8).collect())
    assert got == sorted(set(brute(rows, 40))) and len(got) == 121
