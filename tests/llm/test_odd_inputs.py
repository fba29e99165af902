"""Columns with clashing and odd names, nulls, empty and long texts, repeated rows: all operators and stages of the pipeline."""

import json

import pytest

import corpus_pipeline
from tramline.llm import crf, lc_parse, minhash, quality, secrets, sp_codec, suffix_dedup, token_rollup, tool_chat, wu_manber

ODD = ("__nth", "__gone", "a.b", "text_", "rid", "c0", "c1", "nth", "bucket", "leader", "sig", "k1", "k2", "name", "places", "u", "v", "node", "label", "duplicate_of", "x y", "k`q", "size", "keep", "language", "ids", "begin", "end", "version", "n_tokens", "n_docs")
LONG = "alpha beta gamma delta " * 60_000
NAMES = ["doc_id", "text", "lang", "source", "n_chars", *ODD]
TYPES = ["long", "string", "string", "string", "int"] + ["string"] * len(ODD)


def frame(spark, rows):
    quoted = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in zip(NAMES, TYPES, strict=True))
    return spark.createDataFrame([(d, t, g, None if d is None else "s", None if t is None else len(t), *([f"{d}"] * len(ODD))) for d, t, g in rows], quoted)


ROWS = [(1, "the quick brown fox jumps over the lazy dog again and again", "en"), (1, "the quick brown fox jumps over the lazy dog again and again", "en"), (2, None, None), (3, "", "en"), (None, "some words that have no number at all", "en"), (4, LONG, "en"), (5, "token = k000Zk001Zk002Zk003Z for user=alice and some more english words here", "en"), (6, "ein deutscher satz mit einigen worten der hier steht", "de")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "ein deutscher satz mit einigen worten", "z"), (None, "the quick brown fox jumps over", "z"), (2, None, "z")], "item_id long, text string, doc_id string")


def test_operators(spark, odd, bench):
    marked = spark.createDataFrame([(1, 1, 0, "x"), (None, 1, 0, "x"), (6, None, 1, "x"), (5, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    n = len(ROWS)
    assert crf.labelled(odd).count() == n
    assert sp_codec.encoded(odd).where("decoded_ok").count() == n
    assert sum(r.n_docs for r in token_rollup.rolled(odd).collect()) == n
    assert minhash.near_duplicates(odd).collect() == []
    assert quality.quality_scores(odd, marked).count() == n
    assert {r.doc_id for r in suffix_dedup.repeated(odd, least=8, gram=4).collect()} == {1, 4}
    assert [(r.doc_id, r.item_id) for r in wu_manber.contaminated(odd, bench).collect()] == [(6, 1)]
    assert lc_parse.fingerprints(odd).count() == n
    assert {r.doc_id for r in secrets.scanned(odd).collect()} == {5}


def test_operators_on_empty_tables(spark, odd, bench):
    none, no_bench = odd.limit(0), bench.limit(0)
    marked = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (crf.labelled(none), sp_codec.encoded(none), token_rollup.rolled(none), minhash.near_duplicates(none), quality.quality_scores(none, marked), suffix_dedup.repeated(none), wu_manber.contaminated(none, no_bench), lc_parse.fingerprints(none), secrets.scanned(none)):
        assert out.collect() == []


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_pass_all_columns_through(spark, odd, bench, tmp_path, stage):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, function = stage
    out = function(spark, odd, str(tmp_path))
    assert out.columns == odd.columns and [t for _, t in out.dtypes] == [t for _, t in odd.dtypes]
    got = out.collect()
    want = {"language_id": [1, 1, 4, 5, 6, None], "near_duplicates": [1, 2, 3, 4, 5, 6, None], "decontamination": [1, 1, 2, 3, 4, 5, None], "secret_scan": [1, 1, 2, 3, 4, 5, 6, None]}[name]
    assert sorted((r["doc_id"] for r in got), key=lambda d: (d is None, d)) == want
    for r in got:
        assert all(r[c] == str(r["doc_id"]) for c in ODD)
        whole = [t for d, t, _ in ROWS if d == r["doc_id"]][0]
        assert r["text"] == whole if name != "secret_scan" or r["doc_id"] != 5 else "[SECRET]" in r["text"]
    assert function(spark, odd.limit(0), str(tmp_path)).collect() == []


def test_the_last_stage(spark, odd, tmp_path):
    out = corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_ok"] and out.where("decoded_ok").count() == len(ROWS)


def test_chat(spark):
    quoted = "conv_id long, turn int, role string, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in ODD)
    deep = "[" * 5000 + "]" * 5000
    texts = [
        ("tool", '{"tool_call_id": "x", "content": "\\ud800"}'), ("assistant", '{"tool_calls": [{"id": "x", "name": "f", "arguments": {"q": 1e999}}]}'), ("assistant", '{"tool_calls": [{"id": "x", "name": "f", "arguments": {"q": 1}}]}'),
        ("assistant", '{"tool_calls": ' + deep + "}"), ("system", '{"tools": [{"name": "f", "parameters": {"type": "object", "required": [{"a": 1}, ["b"], "q"], "properties": {"q": {"enum": [1.0, 2]}}}}]}'), ("user", "x" * 200_000),
    ]
    rows = [(7, i, r, t) for i, (r, t) in enumerate(texts)] + [(None, 0, "user", "lost"), (8, None, None, None), (8, None, None, None)]
    got = {r.conv_id: r for r in tool_chat.formatted(spark.createDataFrame([(*r, *(["z"] * len(ODD))) for r in rows], quoted)).collect()}
    assert sorted(got) == [7, 8] and got[8].n_messages == 1
    out = json.loads(got[7].json, parse_constant=lambda c: pytest.fail(c))
    assert got[7].n_calls == 1 and got[7].n_linked == 1 and len(out["messages"]) == 6
    assert '"result":"\\ud800"' in got[7].json
