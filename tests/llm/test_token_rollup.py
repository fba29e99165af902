import collections

import public_tokenizers
import tiktoken

from tests.llm.conftest import ODD
from tramline.llm import token_rollup as tr


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens, r.n_chars) for r in rollup.totals().collect()}


def test_counts_against_the_library(docs):
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tr.encoding(tr.RANKS)._mergeable_ranks, special_tokens={})
    texts = ["Hello  world\n\n x", "漢字 ümläut don't we'll", "   ", "a" * 500, "<|endoftext|>", "tab\t\tend "]
    got = {r.doc_id: r.n_tokens for r in tr.counted(docs(list(enumerate(texts)))).collect()}
    assert got == {i: len(own.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_batches_count_once_and_deltas_add_up(spark, docs):
    a, b = docs([(1, "one two", "en"), (2, "three", "de"), (3, "four", "de")]), docs([(2, "three three three", "de")])
    rollup = tr.Rollup(spark)
    counts = tr.counted(a)
    assert rollup.commit("b1", tr.inserts(counts)) and not rollup.commit("b1", tr.inserts(counts))
    before = counts.where("doc_id = 2")
    assert rollup.commit("b2", tr.revisions(before, tr.counted(b)))
    assert rollup.commit("b3", tr.deletes(counts.where("doc_id = 1")))
    expected = collections.Counter()
    for text in ("three three three", "four"):
        expected["d"] += 1
        expected["t"] += len(tr.encoding(tr.RANKS).encode_ordinary(text))
        expected["c"] += len(text)
    whole = {("s", "de", tr.VERSION): (expected["d"], expected["t"], expected["c"])}
    assert totals(rollup) == whole
    rollup.compact()
    assert totals(rollup) == whole
    assert not rollup.commit("b2", tr.inserts(counts)) and totals(rollup) == whole
    assert rollup.commit("b4", tr.inserts(counts.where("doc_id = 1"))) and len(totals(rollup)) == 2
    rollup.compact()
    assert len(totals(tr.Rollup(spark, rollup.path))) == 2


def test_an_unfinished_attempt_counts_nothing(spark, docs):
    rollup = tr.Rollup(spark)
    tr.inserts(tr.counted(docs([(1, "lost")]))).write.parquet(f"{rollup.path}/attempt-x/data")
    assert totals(rollup) == {} and rollup.commit("x", tr.inserts(tr.counted(docs([(1, "kept")])))) and len(totals(rollup)) == 1


def test_odd_rows(spark, docs):
    rows = tr.rolled(docs([*ODD, (9, "no language", None)])).collect()
    assert {r.lang: r.n_docs for r in rows} == {"en": len(ODD), None: 1}
    assert tr.rolled(docs([])).collect() == []
    bare = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert [(r.source, r.n_docs) for r in tr.rolled(bare).collect()] == [(None, 1)]


def test_the_query_adds_up_signed_deltas(spark, docs, monkeypatch):
    committed, commit = {}, tr.Rollup.commit

    def spy(self, batch, deltas):
        done = commit(self, batch, deltas)
        if done:
            committed[batch] = tuple(deltas.selectExpr("sum(n_docs)", "sum(n_tokens)", "sum(n_chars)", "min(n_docs)").first())
        return done

    monkeypatch.setattr(tr.Rollup, "commit", spy)
    texts = ["one two three four", "fünf sechs", "x"]
    rows = tr.rolled(docs(list(enumerate(texts)))).collect()
    count = lambda own: (3, sum(len(tr.encoding(tr.RANKS).encode_ordinary(t)) for t in own), sum(map(len, own)))
    whole, half = count(texts), count([t[: len(t) // 2] for t in texts])
    assert [(r.n_docs, r.n_tokens, r.n_chars) for r in rows] == [whole]
    assert committed == {
        "documents": (*half, 1), "documents.revised": (0, whole[1] - half[1], whole[2] - half[2], -1), "documents.deleted": (*(-n for n in whole), -1), "documents.restored": (*whole, 1),
    }


def test_two_attempts_at_once(spark, docs):
    """The other attempt's rename comes between this one's look and its own rename."""
    rollup, other = tr.Rollup(spark), None
    other = tr.Rollup(spark, rollup.path)
    deltas = tr.inserts(tr.counted(docs([(1, "one two")])))

    class Late:
        def __init__(self, fs):
            self.fs, self.first = fs, True

        def exists(self, path):
            if self.first and path.getName() == "batch-x":
                self.first = False
                assert other.commit("x", deltas)
                return False
            return self.fs.exists(path)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    rollup._fs = Late(rollup._fs)
    assert not rollup.commit("x", deltas)
    assert [r.n_docs for r in rollup.totals().collect()] == [1]
    left = [s.getPath().getName() for s in other._fs.listStatus(other._root)]
    inside = [s.getPath().getName() for s in other._fs.listStatus(other._at("batches/batch-x"))]
    assert left == ["batches"] and inside == ["data"]
