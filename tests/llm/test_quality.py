import numpy as np
import pyarrow as pa

from tests.llm.conftest import ODD
from tramline.llm import quality
from tramline.llm.textnum import hash_word

LABELS = "doc_id long, quality int, toxic int, extra string"
GOOD, BAD, RUDE = "calm careful prose about gardens", "BUY!!! cheap $$$ now", "you stupid worthless idiot"


def corpus(n=120):
    rows, labels = [], []
    for i in range(n):
        kind = i % 3
        rows.append((i, f"{(GOOD, BAD, GOOD + ' ' + RUDE)[kind]} number w{i}"))
        labels.append((i, int(kind != 1), int(kind == 2), "x"))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    got = {r.doc_id: r for r in quality.quality_scores(docs(rows), spark.createDataFrame(labels[:90], LABELS)).collect()}
    assert all((got[i].quality >= 0.5) == bool(labels[i][1]) and (got[i].toxic >= 0.5) == bool(labels[i][2]) for i in range(90, 120))
    assert all(got[i].keep == (i % 3 == 0) for i in range(90, 120))


def test_updates_against_a_plain_loop():
    rows, y = [np.array([1, 5]), np.array([2, 5]), np.array([1, 2, 3])], np.array([1, 0, 1])
    got = quality.train(rows, y, bits=4, epochs=3)
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for x, label in zip(rows, y, strict=True):
            own = [*x.tolist(), 16]
            w = [weight(i) for i in own]
            g = 1 / (1 + np.exp(-sum(w))) - label
            for i, wi in zip(own, w, strict=True):
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA
                z[i] += g - s * wi
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(17)], atol=1e-6)


def test_features_are_words_and_pairs():
    flat, first = quality.features(pa.array(["one two one", "", "two"]))
    shift = 64 - quality.BITS
    assert set(flat[first[0] : first[1]].tolist()) >= {hash_word("one") >> shift, hash_word("two") >> shift}
    assert np.diff(first).tolist() == [4, 0, 1]


def test_sample_is_bounded_and_the_same(spark, docs):
    rows, labels = corpus()
    a, b = (quality.fit(docs(rows).repartition(k), spark.createDataFrame(labels, LABELS), sample=20) for k in (1, 5))
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0, ""), (3, 1, 0, ""), (3, 0, 1, ""), (None, 1, 1, ""), (5, None, 0, ""), (99, 1, 0, "")], LABELS)
    got = quality.quality_scores(docs(ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 for r in got)
    none = quality.quality_scores(docs(ODD), spark.createDataFrame([], LABELS)).collect()
    assert all(r.keep and r.quality == 0.5 and r.toxic == 0.5 for r in none)
    assert quality.quality_scores(docs([]), labels).collect() == []
