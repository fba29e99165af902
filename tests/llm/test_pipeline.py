import random

import sentencepiece

import corpus_pipeline
from tests.llm.conftest import ODD
from tramline.llm import sp_codec

HEX = "3f9c1b7a4e5d60218c7f9ab3d4e5f60718293a4b"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))


def rows():
    own = [(i, words(40 + i, i)) for i in range(20)]
    own += [(30, own[4][1]), (31, own[5][1] + " more"), (32, "before " + BENCH + " after " + words(30, 99)), (33, f'{words(20, 50)} token = "{HEX}" {words(20, 51)}'), (34, "0 1 2 3"), (35, "")]
    return own


BENCH = words(20, 777)


def folder(spark, docs, tmp_path, own):
    docs(own).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_against_a_plain_version(spark, docs, tmp_path):
    kept, seen = [], []
    for i, text in sorted(rows()):
        if not any(w.isalpha() for w in text.split()):
            continue
        w = text.split()
        grams = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        if any(len(grams & g) / len(grams | g) >= 0.5 for g in seen):
            continue
        seen.append(grams)
        bench = BENCH.split()
        if any(" ".join(bench[k : k + 13]) in text for k in range(len(bench) - 12)):
            continue
        kept.append((i, text.replace(HEX, "[SECRET]")))
    library = sentencepiece.SentencePieceProcessor(model_file=sp_codec.MODEL)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder(spark, docs, tmp_path, rows())).collect()}
    assert got == {i: library.encode(t) for i, t in kept}
    assert set(got) == {*range(20), 33}


def test_stages_keep_the_columns(spark, docs, tmp_path):
    path = folder(spark, docs, tmp_path, [*rows(), *ODD])
    own = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, path)
        assert out.columns == own.columns and out.dtypes == own.dtypes
        assert out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "encoding"]


def test_empty_tables(spark, docs, tmp_path):
    path = folder(spark, docs, tmp_path, [])
    assert corpus_pipeline.run(spark, path).collect() == []
