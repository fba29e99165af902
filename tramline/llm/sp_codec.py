"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct segments (a run of word marks and what follows it up to the next mark) are concatenated and
indexed by a suffix array sorted to the depth of the longest piece. Every piece of the vocabulary is looked up by
binary search, which gives its range of occurrences; these edges are sorted by position and kept with one mask of lengths for each
position. Edges are then relaxed within each segment. The vocabulary is a BPE model, so an edge is relaxed when its score is the best of all
edges that join two neighbouring symbols, the leftmost of equals first: that is the order that defines this model's
result, and a best-path relaxation over added scores gives other ids. Results equal the sentencepiece library's.

Defined results. Null and empty texts have no ids and decode to the empty text. Text that contains the word mark
U+2581 itself decodes to a space there, as in the library. Characters outside the vocabulary become byte pieces.
Each row is encoded by itself, so repeated rows and null doc_ids stay as they are; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tramline.llm.shared import returning, texts
from tramline.llm.textnum import buffers, lists, mix, pieces, powers, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_MARK, _SEPARATOR = 0x2581, 0x110000
#: Segments of more characters are merged with a heap instead of in step with the others; the result is the same.
_LONG = 400
#: Bytes that are worked on at a time; a longer text is cut between its segments.
PART = 1 << 20


class Vocabulary:
    """Pieces, ranks by score (1 is the best; equal scores share a rank) and byte pieces of a model file."""

    def __init__(self, model: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        n = p.get_piece_size()
        special = np.array([p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i) for i in range(n)])
        text = [p.id_to_piece(i) for i in range(n)]
        scores = np.array([p.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64) + 1
        self.bytes_id = np.full(256, p.unk_id(), np.int32)
        self.single: dict[int, int] = {}
        self.surface: list[bytes] = []
        longer = []
        for i, t in enumerate(text):
            if p.is_byte(i):
                self.bytes_id[int(t[3:5], 16)] = i
                self.surface.append(bytes([int(t[3:5], 16)]))
            else:
                self.surface.append(b"" if special[i] else t.replace("▁", " ").encode())
            if not special[i]:
                if len(t) == 1:
                    self.single[ord(t)] = i
                else:
                    longer.append(i)
        self.longer = np.array(longer, np.int32)
        self.size = np.array([len(text[i]) for i in longer])
        self.deepest = int(self.size.max())
        self.codes = np.zeros((len(longer), self.deepest), np.uint32)
        for row, i in enumerate(longer):
            self.codes[row, : len(text[i])] = [ord(c) for c in text[i]]
        self.surface_first = np.concatenate([[0], np.cumsum([len(s) for s in self.surface])])
        self.surface_data = np.frombuffer(b"".join(self.surface), np.uint8)


def _bisect(keys: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """For each i the place of value[i] in keys[low[i]:high[i]], which is sorted."""
    low, high = low.copy(), high.copy()
    top = len(keys) - 1
    for _ in range(int(max(1, (high - low).max(initial=1))).bit_length()):
        middle = (low + high) >> 1
        key = keys[np.minimum(middle, top)]
        up = (low < high) & ((key <= value) if right else (key < value))
        down = (low < high) & ~up
        low[up] = middle[up] + 1
        high[down] = middle[down]
    return low


class Edges:
    """The pieces that occur in a text, sorted by position.

    mask[i] has bit l - 1 where a piece of l characters begins at i; its pieces are piece[first[i]:], by length.
    """

    __slots__ = ("mask", "first", "piece", "deepest")

    def __init__(self, n: int, deepest: int, at: np.ndarray, size: np.ndarray, piece: np.ndarray):
        self.deepest = deepest
        # Position, length and piece in one number, as there is one piece at most of a length at a position.
        key = np.sort((at << 28) | (size.astype(np.int64) << 22) | piece)
        at, size, self.piece = key >> 28, (key >> 22) & 63, (key & ((1 << 22) - 1)).astype(np.int32)
        self.first = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(at, minlength=n), out=self.first[1:])
        self.mask = np.zeros(n, np.uint64)
        if len(at):
            start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            self.mask[at[start]] = np.bitwise_or.reduceat(np.uint64(1) << (size - 1).astype(np.uint64), start)

    def find(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The piece of each size, at most deepest, at each place, or -1."""
        if not len(self.piece):
            return np.full(len(at), -1, np.int32)
        mask, bit = self.mask[at], np.uint64(1) << (size - 1).astype(np.uint64)
        place = self.first[at] + np.bitwise_count(mask & (bit - np.uint64(1)))
        return np.where(mask & bit, self.piece[np.minimum(place, len(self.piece) - 1)], np.int32(-1))

    def __getitem__(self, key: tuple[int, int]) -> int:
        """The piece of so many characters more than one at a place, or -1."""
        return int(self.find(np.array([key[0]]), np.array([key[1] + 1]))[0])

    def reach(self) -> np.ndarray:
        """For each place where the edges that begin there or before end at the latest; a place itself where none does."""
        length = np.frexp(self.mask.astype(np.float64))[1]
        # Rounding of a mask to 53 bits can only lengthen, by one; pieces of over 53 characters keep a segment whole.
        return np.maximum.accumulate(np.arange(len(self.mask)) + length)


def _suffixes(code: np.ndarray, text: np.ndarray, bits: int, per: int, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of text, and its suffixes' keys of per characters each in that order.

    A key is 0 beyond the separator. Later keys are made, and sorted by, only for suffixes that reach so far.
    """
    n = len(text)
    stops = np.flatnonzero(text == _SEPARATOR)
    left = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(n)

    def packed(at: np.ndarray | slice, begin: int, size: np.ndarray) -> np.ndarray:
        key = np.zeros(len(size), np.uint64)
        for c in range(begin, begin + per):
            key <<= np.uint64(bits)
            key |= code[c : c + n] if isinstance(at, slice) else code[at + c]
        spare = ((per - np.clip(size, 1, per)) * bits).astype(np.uint64)
        return np.where(size > 0, (key >> spare) << spare, np.uint64(0))

    key = packed(slice(None), 0, left)
    order = np.argsort(key)
    keys = [key[order]]
    new = np.ones(n, bool)
    for w in range(1, words):
        new[1:] = (keys[-1][1:] != keys[-1][:-1]) if w == 1 else new[1:] | (keys[-1][1:] != keys[-1][:-1])
        at = np.flatnonzero(left[order] >= w * per)
        own = order[at]
        key = packed(own, w * per, left[own] - w * per)
        again = np.lexsort((key, np.cumsum(new)[at]))
        order[at] = own[again]
        whole = np.zeros(n, np.uint64)
        whole[at] = key[again]
        keys.append(whole)
    return order, keys


def edges(text: np.ndarray, vocabulary: Vocabulary) -> Edges:
    """All occurrences of pieces in text, which ends segments by a separator."""
    n, depth = len(text), vocabulary.deepest
    none = np.zeros(0, np.int64)
    alphabet = np.unique(text)
    alphabet = alphabet[alphabet != _SEPARATOR]
    bits = max(1, int(len(alphabet) + 2).bit_length())
    per = 64 // bits
    words = -(-depth // per)
    place = np.minimum(np.searchsorted(alphabet, vocabulary.codes), max(0, len(alphabet) - 1))
    inside = np.arange(depth)[None, :] < vocabulary.size[:, None]
    known = ((alphabet[place] == vocabulary.codes) | ~inside).all(axis=1) if len(alphabet) else np.zeros(len(place), bool)
    piece, size = vocabulary.longer[known], vocabulary.size[known]
    if not len(piece):
        return Edges(n, depth, none, none, none.astype(np.int32))
    codes = np.where(inside[known], place[known] + 1, 0).astype(np.uint64)
    codes = np.pad(codes, ((0, 0), (0, words * per - depth)))
    code = np.zeros(n + words * per, np.uint64)
    code[:n] = np.searchsorted(alphabet, text) + 1
    suffixes, keys = _suffixes(code, text, bits, per, words)
    low, high = np.searchsorted(keys[0], 0, "right") * np.ones(len(piece), np.int64), np.full(len(piece), n, np.int64)
    for w in range(words):
        left = size - w * per
        live = np.flatnonzero(left > 0)
        if not len(live):
            break
        first = np.zeros(len(live), np.uint64)
        for c in range(per):
            first = (first << np.uint64(bits)) | codes[live, w * per + c]
        free = np.maximum(0, per - left[live]).astype(np.uint64) * np.uint64(bits)
        last = first | ((np.uint64(1) << free) - np.uint64(1))
        if w:
            a, b = low[live], high[live]
            low[live], high[live] = _bisect(keys[w], a, b, first, False), _bisect(keys[w], a, b, last, True)
        else:
            low[live], high[live] = np.searchsorted(keys[0], first, "left"), np.searchsorted(keys[0], last, "right")
        keys[w] = None
    count = high - low
    return Edges(n, depth, suffixes[spread(low, count)], np.repeat(size, count), np.repeat(piece, count))


def _heap(found: Edges, rank: np.ndarray, begin: int, end: int, size: np.ndarray) -> None:
    """Relax the edges of one long segment; size gets the lengths of its symbols at their first positions."""
    deepest, shift = found.deepest, (end - begin).bit_length()
    mask, first = found.mask[begin:end].tolist(), found.first[begin : end + 1].tolist()
    cost = rank[found.piece[first[0] : first[-1]]].tolist()
    n, base = end - begin, first[0]
    after, ahead, own = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("b", b"\x01" * n)
    queue: list[int] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (k := after[j] - i) <= deepest and mask[i] >> (k - 1) & 1:
            price = cost[first[i] - base + (mask[i] & ((1 << (k - 1)) - 1)).bit_count()]
            heapq.heappush(queue, ((price << shift | i) << 6) | k)

    for i in range(n):
        push(i)
    while queue:
        top = heapq.heappop(queue)
        i, k = (top >> 6) & ((1 << shift) - 1), top & 63
        j = after[i]
        # A symbol that has been joined to its left has no size; one that has grown since has another neighbour.
        if not own[i] or j >= n or after[j] - i != k:
            continue
        after[i], own[i], own[j] = after[j], k, 0
        if after[i] < n:
            ahead[after[i]] = i
        push(i)
        if ahead[i] >= 0:
            push(ahead[i])
    size[begin:end] = np.frombuffer(own, np.int8)


def relax(found: Edges, rank: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbol length at each position where a symbol begins after all merges, else 0."""
    n, deepest = len(found.mask), found.deepest
    none, low = np.int64(1) << 22, np.int64((1 << 40) - 1)
    if len(rank) >= none:
        raise ValueError(f"a vocabulary of {len(rank)} pieces")
    size = np.zeros(n, np.int32)
    size[spread(begins, ends - begins)] = 1
    # No merge crosses a place that no edge spans: a segment is cut there.
    open_at = np.zeros(n + 1, bool)
    open_at[1:] = found.reach() <= np.arange(1, n + 1)
    open_at[begins] = True
    inner = np.zeros(n + 1, np.int8)
    inner[begins] += 1
    inner[ends] -= 1
    begins = np.flatnonzero(open_at[:n] & (np.cumsum(inner[:n], dtype=np.int32) > 0))
    ends = np.minimum(np.append(begins[1:], n), ends[np.searchsorted(ends, begins, "right")])
    for b, e in zip(begins[ends - begins > _LONG].tolist(), ends[ends - begins > _LONG].tolist(), strict=True):
        _heap(found, rank, b, e, size)
    short = np.flatnonzero((ends - begins <= _LONG) & (ends - begins > 1))
    lengths = (ends - begins)[short]
    at = spread(begins[short], lengths)
    segment = np.repeat(np.arange(len(short)), lengths)

    def joined(left: np.ndarray) -> np.ndarray:
        """Rank of joining the symbols at indexes left and left+1 of at, or none."""
        i, j = at[left], np.minimum(left + 1, len(at) - 1)
        long = size[i] + size[at[j]]
        ok = (j > left) & (segment[j] == segment[left]) & (long <= deepest)
        piece = found.find(i, np.minimum(long, deepest))
        return np.where(ok & (piece >= 0), rank[piece], none)

    cost = joined(np.arange(len(at)))
    while len(at):
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        best = np.minimum.reduceat((cost << 40) | np.arange(len(at)), first)
        alive = (best >> 40) < none
        win = best[alive] & low
        size[at[win]] += size[at[win + 1]]
        size[at[win + 1]] = 0
        keep = np.repeat(alive, np.diff(np.append(first, len(at))))
        keep[win + 1] = False
        moved = np.cumsum(keep) - 1
        again = moved[win]
        at, segment, cost = at[keep], segment[keep], cost[keep]
        again = np.concatenate([again, again[again > 0] - 1])
        cost[again] = joined(again)
    return size


def _parts(data: np.ndarray, offsets: np.ndarray, most: int) -> np.ndarray:
    """Places that cut the rows, all of whose starts are among them: long rows are cut before a space that follows another character."""
    cuts = np.unique(offsets)
    if np.diff(cuts).max(initial=0) <= most:
        return cuts
    space = np.flatnonzero((data[1:] == 0x20) & (data[:-1] != 0x20) & (data[:-1] != 0x81)) + 1
    wanted = np.searchsorted(space, np.arange(most, len(data), most))
    return np.unique(np.concatenate([cuts, space[wanted[wanted < len(space)]]]))


def encode(column: pa.Array, vocabulary: Vocabulary, most: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids, and the n+1 offsets of the rows in them. About so many bytes are worked on at a time, however long a text is."""
    data, offsets = buffers(column)
    cuts = _parts(data, offsets, most)
    fresh = np.isin(cuts, offsets)
    out, first = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    begin, total = 0, 0
    while begin < len(cuts) - 1:
        end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + most, "right")) - 1)
        ids, own = _encode(data[cuts[begin] : cuts[end]], cuts[begin : end + 1] - cuts[begin], fresh[begin:end], vocabulary)
        out.append(ids)
        first.append(total + own[1:])
        total += len(ids)
        begin = end
    return np.concatenate(out), np.concatenate(first)[np.searchsorted(cuts, offsets)]


def _encode(data: np.ndarray, offsets: np.ndarray, fresh: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of parts of rows, none of them empty; fresh are those that begin a row and get a mark in front."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    begin = places[:-1] + np.cumsum(fresh) - fresh
    text = np.full(len(codes) + int(fresh.sum()), _MARK, np.uint32)
    own = np.ones(len(text), bool)
    own[begin[fresh]] = False
    text[own] = np.where(codes == 0x20, _MARK, codes)
    mark = text == _MARK
    start = mark & ~np.concatenate([[False], mark[:-1]])
    start[begin] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(text))
    up, down = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=total[1:])
    _, which, inverse = np.unique(mix((total[ends] - total[starts]) * down[starts]), return_index=True, return_inverse=True)
    del total, own, mark, codes
    lengths = (ends - starts)[which]
    ends_u = np.cumsum(lengths + 1) - 1
    begins_u = ends_u - lengths
    unique = np.full(int(ends_u[-1]) + 1, _SEPARATOR, np.uint32)
    unique[spread(begins_u, lengths)] = text[spread(starts[which], lengths)]
    found = edges(unique, vocabulary)
    size = relax(found, vocabulary.rank, begins_u, ends_u)
    at = np.flatnonzero(size)
    ids = found.find(at, size[at])
    alone = np.flatnonzero(size[at] == 1)
    chars, back = np.unique(unique[at[alone]], return_inverse=True)
    spelled = [[vocabulary.single[c]] if c in vocabulary.single else vocabulary.bytes_id[list(chr(c).encode())].tolist() for c in chars.tolist()]
    many = np.ones(len(at), np.int64)
    ids[alone] = np.array([s[0] for s in spelled], np.int32)[back]
    many[alone] = np.array([len(s) for s in spelled])[back]
    flat = np.repeat(ids, many)
    place = np.cumsum(many) - many
    for k in range(1, 4):
        more = alone[many[alone] > k]
        flat[place[more] + k] = np.array([s[k] if len(s) > k else -1 for s in spelled], np.int32)[back[many[alone] > k]]
    n_ids = np.add.reduceat(many, np.searchsorted(at, begins_u))
    first = np.cumsum(n_ids) - n_ids
    out = flat[spread(first[inverse], n_ids[inverse])]
    cut = np.concatenate([[0], np.cumsum(n_ids[inverse])])
    return out, cut[np.searchsorted(starts, np.append(begin, len(text)))]


def decode(ids: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> pa.Array:
    """The texts of rows of ids: surfaces joined, less the one space that encoding puts in front."""
    begin, length = vocabulary.surface_first[ids], np.diff(vocabulary.surface_first)[ids]
    front = first[:-1][np.diff(first) > 0]
    spaced = front[vocabulary.surface_data[np.minimum(begin[front], len(vocabulary.surface_data) - 1)] == 0x20] if len(front) else front
    begin, length = begin.copy(), length.copy()
    begin[spaced] += 1
    length[spaced] -= 1
    data = vocabulary.surface_data[spread(begin, length)]
    offsets = np.concatenate([[0], np.cumsum(length)])[first]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_ok): ids of each text, and whether they decode to the text again.

    The vocabulary is read on the driver and broadcast: its size is the model's and doesn't follow the data.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            for part in pieces(batch, most=1 << 20):
                column = part.column("text")
                ids, first = encode(column, vocabulary)
                back = decode(ids, first, vocabulary)
                same = pa.array([x == y or (x is not None and x.replace("▁", " ") == y) for x, y in zip(column.to_pylist(), back.to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists(ids, first, pa.int32()), pa.array(np.diff(first).astype(np.int64)), same], ["doc_id", "ids", "n_tokens", "decoded_ok"])

    return texts(docs).mapInArrow(returning(run), "doc_id long, ids array<int>, n_tokens long, decoded_ok boolean")


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of a table (doc_id, ids); null ids decode to the empty text."""
    sent = tokens.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x or [] for x in batch.column("ids").to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            flat = np.fromiter((i for x in rows for i in x), np.int64, int(first[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), decode(flat, first, sent.value)], ["doc_id", "text"])

    return tokens.selectExpr("cast(doc_id as long) as doc_id", "ids").mapInArrow(run, "doc_id long, text string")
