import random

import pyarrow as pa

from tests.llm.conftest import ODD
from tramline.llm import wu_manber
from tramline.llm.textnum import Words



def bench_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(docs, items, n=13, least=5):
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for item, t in items:
            p = (t or "").lower().split()
            if len(p) < least or item is None:
                continue
            m = min(n, len(p))
            grams = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)}
            hits = sum(tuple(w[i : i + m]) in grams for i in range(len(w) - m + 1))
            if hits:
                out[(d, item)] = out.get((d, item), 0) + hits
    return out


def test_against_brute_force(spark, docs):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randrange(3, 40)))) for i in range(30)]
    rows = []
    for d in range(80):
        parts = [" ".join(r.choices(vocabulary, k=r.randrange(0, 60))) for _ in range(3)]
        if d % 3 == 0:
            parts.insert(1, r.choice(items)[1].upper())
        rows.append((d, " ".join(parts)))
    got = {(x.doc_id, x.item_id): x.n_windows for x in wu_manber.contaminated(docs(rows), bench_of(spark, items)).collect()}
    assert got == brute(rows, items) and len(got) > 20
    clean = {x.doc_id for x in wu_manber.uncontaminated(docs(rows), bench_of(spark, items)).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in got}


def test_several_passes_agree(spark, docs, monkeypatch):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(12)]
    rows = [(i, "before " + items[i][1] + " after") for i in range(12)]
    whole = sorted(map(tuple, wu_manber.contaminated(docs(rows), bench_of(spark, items)).collect()))
    monkeypatch.setattr(wu_manber, "PASS_BYTES", 300)
    assert sorted(map(tuple, wu_manber.contaminated(docs(rows), bench_of(spark, items)).collect())) == whole
    assert wu_manber.uncontaminated(docs(rows), bench_of(spark, items)).collect() == []


def test_windows_do_not_cross_rows():
    p = wu_manber.Patterns([(1, "a b c d e f")])
    row, _, _ = p.search(Words(pa.array(["x a b c", "d e f y", "a, B c. d e f"])))
    assert row.tolist() == [2]


def test_odd_rows(spark, docs):
    items = [(1, None), (2, ""), (None, "one two three four five six"), (4, "one two three four five six"), (5, "too short")]
    got = sorted((str(x.doc_id), x.item_id, x.n_windows) for x in wu_manber.contaminated(docs(ODD), bench_of(spark, items)).collect())
    assert got == [("3", 4, 2), ("None", 4, 1)]
    assert wu_manber.contaminated(docs(ODD), bench_of(spark, [])).collect() == []
    assert wu_manber.uncontaminated(docs(ODD), bench_of(spark, [])).count() == len(ODD)
    assert wu_manber.contaminated(docs([]), bench_of(spark, items)).collect() == []
