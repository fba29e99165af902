"""Language ID by a linear-chain conditional random field over words.

Each word has affix features (first and last one to four bytes), byte n-grams of one to four, a lexicon feature (the
word itself) and its shape; transitions between neighbouring labels are learnt with them. Labels are the languages of
the training rows and OTHER, for words with a digit and those of rows whose language is OTHER; made lines of numbers and codes are trained with them. A chain is a line of text. Words are
labelled by their marginals from forward-backward; chains of a batch run side by side, and chains longer than BLOCK words are
cut into blocks whose transfer matrices give the exact messages at the cuts.

Training rows are a bounded sample: the SAMPLE documents with a language or OTHER that are least by a hash of doc_id, and CHAINS
chains of them. Half of the chains are spliced from chains of two languages, so that switches are learnt. Every
document is labelled, over its whole text.

A document's language is that with the largest sum of marginals over its words; ties go to the first by name. It is kept
if the languages together have at least LEAST of its words' marginals, and rejected else: empty, null and word-less texts,
numbers, codes and junk, also with a stray word among them. Of the documents of sf0.1 none has a share below 0.33.

Defined results. Null and empty texts have no words, language null, confidence 0 and keep false, as all that is rejected. Rows without doc_id are
labelled too; repeated rows get equal results. Without any training row in a language every word is OTHER and everything that has a
word is kept; a table without a column lang has none. Very long texts are chains of lines, and long lines are cut into blocks with exact
messages. An empty table gives an empty result. labelled() doesn't read other columns, whatever their names; kept() passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import returning, rewritten, texts
from tramline.llm.textnum import Words, mix, pieces, spread

OTHER = "und"
BITS, SAMPLE, CHAINS, EPOCHS, BLOCK = 16, 800, 4000, 2, 256
RATE, L2 = 0.3, 1e-5
#: Least share of a document's words, by their marginals, that must be in a language.
LEAST = 0.25
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SALT = mix(np.arange(1, 17, dtype=np.uint64))


def _slots(codes: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return (mix(codes ^ _SALT[kind]) >> np.uint64(64 - bits)).astype(np.int64)


def features(words: Words, which: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of features: the words (indexes of which) that have any, where each one's begin, and the slots."""
    data = np.concatenate([words.data, np.zeros(4, np.uint8)]).astype(np.uint64)
    start, end = words.starts[which], words.ends[which]
    size = end - start
    yield np.arange(len(which)), np.arange(len(which)), _slots(words.hashes[which], 0, bits)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[words.data])])
    wide = np.concatenate([[0], np.cumsum(words.data > 127)])
    shape = np.minimum(size, 12) * 4 + (digits[end] > digits[start]) * 2 + (wide[end] > wide[start])
    yield np.arange(len(which)), np.arange(len(which)), _slots(shape.astype(np.uint64), 1, bits)
    for n in range(1, 5):
        has = np.flatnonzero(size >= n)
        if not len(has):
            return
        count = size[has] - n + 1
        at = spread(start[has], count)

        def gram(at: np.ndarray, n: int = n) -> np.ndarray:
            code = data[at]
            for k in range(1, n):
                code = (code << np.uint64(8)) | data[at + k]
            return code

        yield has, np.cumsum(count) - count, _slots(gram(at), 1 + n, bits)
        yield has, np.arange(len(has)), _slots(gram(start[has]), 5 + n, bits)
        yield has, np.arange(len(has)), _slots(gram(end[has] - n), 9 + n, bits)


class Model:
    """labels, the last is OTHER; weights[slot, label]; transitions[from, to]."""

    def __init__(self, labels: list[str], bits: int = BITS):
        self.labels, self.bits = labels, bits
        self.weights = np.zeros((1 << bits, len(labels)), np.float32)
        self.transitions = np.zeros((len(labels), len(labels)), np.float32)

    def emissions(self, words: Words, which: np.ndarray) -> np.ndarray:
        """A score for each of these words and each label."""
        out = np.zeros((len(which), len(self.labels)), np.float32)
        for has, first, slots in features(words, which, self.bits):
            if len(has) == len(slots):
                out[has] += self.weights[slots]
            else:
                out[has] += np.add.reduceat(self.weights[slots], first, axis=0)
        return out


def chains(words: Words) -> np.ndarray:
    """First words of the chains: of each row and each line that has words."""
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.int64)
    breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
    begin = np.ones(n, bool)
    begin[1:] = breaks[words.starts[1:]] > breaks[words.ends[:-1]]
    begin[words.first[:-1][words.counts > 0]] = True
    return np.flatnonzero(begin)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _sweep(local: np.ndarray, move: np.ndarray, first: np.ndarray, size: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages at each word; ahead is what comes into each block's first word, behind into its last."""
    order = np.argsort(-size, kind="stable")
    first, size, ahead, behind = first[order], size[order], ahead[order], behind[order]
    lanes = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")
    forward, backward = np.empty_like(local), np.empty_like(local)
    state = ahead
    for t, m in enumerate(lanes.tolist()):
        state = _normal(state[:m] * local[first[:m] + t])
        forward[first[:m] + t] = state
        state = state @ move
    last, state = first + size - 1, behind
    for t, m in enumerate(lanes.tolist()):
        at = last[:m] - t
        state = state[:m]
        backward[at] = state
        state = _normal((local[at] * state) @ move.T)
    return forward, backward


def marginals(scores: np.ndarray, transitions: np.ndarray, first: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of each word's labels in chains that begin at first, and the two messages they are made of."""
    n, k = scores.shape
    local = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-30)
    move = np.exp(transitions - transitions.max()).astype(np.float32)
    size = np.diff(np.append(first, n))
    pieces_of = -(-size // block)
    head = np.repeat(first, pieces_of) + block * (np.arange(int(pieces_of.sum())) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of))
    length = np.minimum(np.repeat(first + size, pieces_of) - head, block)
    ahead, behind = np.ones((len(head), k), np.float32), np.ones((len(head), k), np.float32)
    inner = np.flatnonzero(np.repeat(pieces_of > 1, pieces_of))
    if len(inner):
        across = np.eye(k, dtype=np.float32)[None] * local[head[inner]][:, None, :]
        for t in range(1, block):
            live = np.flatnonzero(length[inner] > t)
            step = (across[live] @ move) * local[head[inner[live]] + t][:, None, :]
            across[live] = step / step.sum(axis=(1, 2), keepdims=True)
        place = {b: i for i, b in enumerate(inner.tolist())}
        stop = np.cumsum(pieces_of)
        for c in np.flatnonzero(pieces_of > 1).tolist():
            a, e = int(stop[c] - pieces_of[c]), int(stop[c])
            for b in range(a, e - 1):
                ahead[b + 1] = _normal(ahead[b] @ across[place[b]] @ move)
            for b in range(e - 1, a, -1):
                behind[b - 1] = _normal(move @ (across[place[b]] @ behind[b]))
    forward, backward = _sweep(local, move, head, length, ahead, behind)
    return _normal(forward * backward), forward, backward


def _numbers(lines: int = 60) -> list[str]:
    """Made lines of numbers and codes, so that OTHER is learnt whatever the training rows hold."""
    random = np.random.Generator(np.random.PCG64(11))
    kinds = (lambda: str(random.integers(0, 10 ** int(random.integers(1, 12)))), lambda: f"{random.integers(1, 1 << 62):x}"[: int(random.integers(2, 16))], lambda: f"{random.integers(1, 32)}{random.choice(list('abcx'))}{random.integers(0, 99)}")
    return [" ".join(kinds[int(random.integers(0, 3))]() for _ in range(int(random.integers(1, 9)))) for _ in range(lines)]


def train(sentences: list[tuple[str, int]], labels: list[str], bits: int = BITS, epochs: int = EPOCHS, batch: int = 128) -> Model:
    """A model of chains (text, label of all its words but those with a digit), by AdaGrad on the log likelihood.

    Every other chain is spliced with the next one: its words are cut at a third and at two thirds and the middle is the other's.
    """
    model = Model(labels, bits)
    k = len(labels)
    sentences = [*sentences, *((line, k - 1) for line in _numbers())] if sentences else []
    words = Words(pa.array([t for t, _ in sentences], pa.string()))
    if not len(words.starts):
        return model
    digit = np.concatenate([[0], np.cumsum(_DIGIT[words.data])])
    target = np.repeat(np.array([y for _, y in sentences]), words.counts)
    target[digit[words.ends] > digit[words.starts]] = k - 1
    rows = [np.arange(words.first[i], words.first[i + 1]) for i in range(words.rows) if words.first[i + 1] > words.first[i]]
    mixed = []
    for i, own in enumerate(rows):
        other = rows[(i + 1) % len(rows)]
        if i % 2:
            a, b = len(own) // 3, 2 * len(own) // 3
            mixed.append(np.concatenate([own[:a], other[len(other) // 3 : max(len(other) // 3 + 1, 2 * len(other) // 3)], own[b:]]))
        else:
            mixed.append(own)
    vocabulary, back = np.unique(words.hashes, return_index=True, return_inverse=True)[1:]
    owners, slots = [], []
    for has, at, slot in features(words, vocabulary, bits):
        owners.append(np.repeat(has, np.diff(np.append(at, len(slot)))))
        slots.append(slot)
    owner, slot = np.concatenate(owners), np.concatenate(slots)
    order = np.argsort(owner, kind="stable")
    slot, begin_of = slot[order], np.searchsorted(owner[order], np.arange(len(vocabulary) + 1))
    square_w, square_t = np.full(model.weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6, np.float32)
    for _ in range(epochs):
        for begin in range(0, len(mixed), batch):
            group = mixed[begin : begin + batch]
            flat = np.concatenate(group)
            first = np.cumsum([0] + [len(g) for g in group[:-1]])
            which, local_back = np.unique(back[flat], return_inverse=True)
            count = begin_of[which + 1] - begin_of[which]
            own = slot[spread(begin_of[which], count)]
            scores = np.add.reduceat(model.weights[own], np.cumsum(count) - count, axis=0)[local_back]
            p, forward, backward = marginals(scores, model.transitions, first)
            wrong = p.copy()
            wrong[np.arange(len(flat)), target[flat]] -= 1
            touched, place = np.unique(own, return_inverse=True)
            word = np.repeat(np.arange(len(which)), count)
            pull = np.stack([np.bincount(local_back, wrong[:, j], len(which)) for j in range(k)], axis=1)
            total = np.stack([np.bincount(place, pull[word, j], len(touched)) for j in range(k)], axis=1).astype(np.float32)
            g = total / len(flat) * 32 + L2 * model.weights[touched]
            square_w[touched] += g * g
            model.weights[touched] -= RATE * g / np.sqrt(square_w[touched])
            inside = np.ones(len(flat), bool)
            inside[first] = False
            b = np.flatnonzero(inside)
            if not len(b):
                continue
            a = b - 1
            local = np.exp(scores[b] - scores[b].max(axis=1, keepdims=True))
            joint = forward[a][:, :, None] * np.exp(model.transitions)[None] * (local * backward[b])[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            seen = np.bincount(target[flat[a]] * k + target[flat[b]], minlength=k * k).reshape(k, k)
            g = ((joint.sum(axis=0) - seen) / len(b) * 32).astype(np.float32)
            square_t += g * g
            model.transitions -= RATE * g / np.sqrt(square_t)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = CHAINS, bits: int = BITS) -> Model:
    """A model of the sampled documents' lines. Both bounds are parameters of training alone."""
    lang = F.col("`lang`") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), lang.cast("string").alias("lang"), F.col("`text`").cast("string").alias("text")).where("doc_id is not null and text is not null and trim(lang) <> ''")
    chosen = rows.select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample)
    table = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 1").groupBy("lang", "line").count().orderBy(F.xxhash64("line"), "line", "lang").limit(most).collect()
    labels = [*sorted({r.lang for r in table} - {OTHER}), OTHER]
    return train([(r.line, labels.index(r.lang)) for r in table], labels, bits) if len(labels) > 1 else Model([OTHER], bits)


def label(column: pa.Array, model: Model) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their marginals and the first words of the chains."""
    words = Words(column)
    if not len(words.starts):
        return words, np.zeros((0, len(model.labels)), np.float32), np.zeros(0, np.int64)
    _, which, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    scores = model.emissions(words, which)[back]
    first = chains(words)
    return words, marginals(scores, model.transitions, first)[0], first


def decide(words: Words, p: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: index of the language or -1, its share of the words' marginals, whether to keep the row; per word its label."""
    k = len(model.labels)
    best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
    total = np.concatenate([np.zeros((1, k)), np.cumsum(p, axis=0, dtype=np.float64)])
    sums = total[words.first[1:]] - total[words.first[:-1]]
    keep = words.counts > 0
    if k > 1:
        keep &= sums[:, : k - 1].sum(axis=1) >= LEAST * words.counts
    lang = np.where(keep & (k > 1), sums[:, : max(1, k - 1)].argmax(axis=1), -1)
    share = np.where(lang >= 0, sums[np.arange(words.rows), np.maximum(lang, 0)] / np.maximum(words.counts, 1), 0.0)
    return lang, share, keep, best


def labelled(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """(doc_id, language, confidence, n_words, keep, spans): spans are the runs of words of one label, as
    (first word, word after the last, label).

    The model that is broadcast has a fixed size.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, sample, bits=bits))
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = pa.array(model.labels, pa.string())
        for batch in batches:
            for part in pieces(batch, most=1 << 20):
                words, p, _ = label(part.column("text"), model)
                lang, share, keep, best = decide(words, p, model)
                new = np.ones(len(best), bool)
                new[1:] = best[1:] != best[:-1]
                new[words.first[:-1][words.counts > 0]] = True
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(best))
                base = words.first[np.searchsorted(words.first, begin, "right") - 1]
                runs = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), names.take(pa.array(best[begin]))], fields=list(span))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, words.first).astype(np.int32)), runs)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), names.take(pa.array(np.where(lang < 0, 0, lang), mask=lang < 0)), pa.array(share), pa.array(words.counts.astype(np.int64)), pa.array(keep), spans], ["doc_id", "language", "confidence", "n_words", "keep", "spans"])

    return texts(docs).mapInArrow(returning(run), "doc_id long, language string, confidence double, n_words long, keep boolean, spans array<struct<begin:int,end:int,label:string>>")


def kept(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is recognised. Column names don't matter but for doc_id, lang and text."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, sample, bits=bits))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, f"c{at}", most=1 << 20):
                words, p, _ = label(part.column(at), sent.value)
                yield part.filter(pa.array(decide(words, p, sent.value)[2]))

    return rewritten(docs, run)
