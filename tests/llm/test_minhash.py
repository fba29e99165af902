import random

from tests.llm.conftest import ODD
from tramline.llm import minhash


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def changed(own, share, seed):
    r = random.Random(seed)
    return [f"c{r.randrange(10**6)}" if r.random() < share else w for w in own]


def shingles(text, k=3):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_recall_against_brute_force(docs):
    rows = []
    for i in range(60):
        own = words(120, i)
        rows.append((2 * i, " ".join(own)))
        rows.append((2 * i + 1, " ".join(changed(own, 0.02 + 0.002 * i, 1000 + i))))
    found = {(r.duplicate_of, r.doc_id) for r in minhash.near_duplicates(docs(rows)).collect()}
    true = set()
    for i in range(60):
        a, b = shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1])
        if len(a & b) / len(a | b) >= 0.5:
            true.add((2 * i, 2 * i + 1))
    assert len(true) > 40 and len(found & true) >= 0.9 * len(true)
    assert all(b == a + 1 for a, b in found)


def test_groups_keep_the_least(docs):
    base = words(80, 5)
    rows = [(10, " ".join(base)), (3, " ".join(base)), (7, " ".join(base[:79])), (8, " ".join(words(80, 6)))]
    assert sorted((r.doc_id, r.duplicate_of) for r in minhash.near_duplicates(docs(rows)).collect()) == [(7, 3), (10, 3)]
    assert sorted(r.doc_id for r in minhash.kept(docs(rows)).collect()) == [3, 8]


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.label for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in nodes}


def test_odd_rows(docs):
    own = docs(ODD)
    assert minhash.near_duplicates(own).collect() == []
    kept = minhash.kept(own)
    assert kept.schema == own.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7", "8", "None"]
    assert minhash.near_duplicates(docs([])).collect() == [] and minhash.kept(docs([])).collect() == []


def test_many_copies(docs):
    own = " ".join(words(50, 9))
    got = minhash.near_duplicates(docs([(i, own) for i in range(500)])).collect()
    assert {r.doc_id for r in got} == set(range(1, 500)) and {r.duplicate_of for r in got} == {0}


def test_links_are_those_of_all_pairs_that_share_a_band(docs):
    """Groups of copies of a few texts that share a passage, and strangers with it, so that buckets have members of many kinds."""
    import numpy as np
    import pyarrow as pa

    from tramline.llm.textnum import Words

    common, rows = words(40, 77), []
    for g in range(5):
        base = [*words(30, 100 + g), *common]
        rows += [(100 * g + i, " ".join(changed(base, 0.01 * i, 10 * g + i))) for i in range(12)]
    rows += [(1000 + i, " ".join([*words(25, 500 + i), *common])) for i in range(30)]
    _, sig = minhash.minima(Words(pa.array([t for _, t in rows])), minhash.PERMUTATIONS, minhash.SHINGLE)
    size = minhash.PERMUTATIONS // minhash.BANDS
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = sig[i] == sig[j]
            if same.mean() >= minhash.THRESHOLD and same.reshape(-1, size).all(axis=1).any():
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    ids = np.array([d for d, _ in rows])
    want = {int(ids[i]): int(ids[root(i)]) for i in range(len(rows)) if root(i) != i}
    assert {r.doc_id: r.duplicate_of for r in minhash.near_duplicates(docs(rows)).collect()} == want and 20 < len(want) < len(rows) - 5
