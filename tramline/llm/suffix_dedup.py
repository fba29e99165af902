"""Repeated passages by suffix arrays over words.

Each task cuts its texts into shards of about SHARD bytes. A shard's words and a separator after each text, which occurs once,
are sorted into a suffix array by Larsson-Sadakane refinement: ranks of the first words are packed into one key, then groups of
equal prefixes, and only these, are split by the rank that lies as far behind as the prefix is long, which doubles.
Kasai's recurrence gives the common prefixes, in lanes that each run over a stretch of the text. A window of LEAST words that has
such a prefix in common with a neighbour is repeated in the shard.

Across shards, each shard sends a sorted run of names: from each window the least hash of its GRAM-word grams selects an
anchor, so equal windows have equal anchors at equal places, and there is one in about 13 words. Of windows that are repeated in
the shard only the first in suffix order sends its anchor. Runs are merged by binary search; names in several places
are looked up again in their texts, which send the hashes of all windows at these anchors, and those runs are
merged by binary search too. A gram that stands in very many texts, such as the words of a licence, doesn't meet in one task: it is
known to be repeated, and its windows go each by its own hash, of which a shard sends one.

A span is the union of repeated windows that overlap or touch. It is reported for every text in which it stands.

Defined results. Null and empty texts, and texts of fewer than LEAST words, have no spans. Windows don't cross texts. Rows
of equal doc_id and text are reported once, but they repeat each other; rows without doc_id are reported with a null id. Case and
punctuation between words don't matter. A long text is a shard of its own. An empty table gives an empty result. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import discard, returning, store, texts
from tramline.llm.textnum import Words, buffers, lists, pieces, spread, window_hashes

LEAST, GRAM, SHARD = 50, 24, 8 << 20
#: One row in SAMPLED shows which grams are hot: those with OFTEN rows among them, the HOT most frequent at most. That settles only how
#: a gram is merged; the result is the same.
SAMPLED, OFTEN, HOT = 64, 64, 1 << 17


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of dense symbols, by Larsson-Sadakane refinement."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = int(symbols.max() + 1).bit_length()
    depth = max(1, min(63 // bits, 8))
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(depth, np.int64)])
    key = padded[:n].copy()
    for k in range(1, depth):
        key <<= bits
        key |= padded[k : k + n]
    sa = np.argsort(key)
    key = key[sa]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    place = np.arange(n)
    while True:
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        rank[sa[place]] = np.repeat(place[start], size)
        place = place[np.repeat(size > 1, size)]
        if not len(place):
            return sa, rank[:n]
        own = sa[place]
        key = rank[own] * (n + 1) + rank[np.minimum(own + depth, n)] + 1
        order = np.argsort(key)
        sa[place], key = own[order], key[order]
        depth *= 2


def common_prefixes(symbols: np.ndarray, sa: np.ndarray, rank: np.ndarray, lanes: int = 2048) -> np.ndarray:
    """lcp[r]: the length that suffixes sa[r-1] and sa[r] have in common, by Kasai's recurrence. The last symbol occurs once."""
    n = len(symbols)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    edge = np.linspace(0, n, min(lanes, n) + 1).astype(np.int64)
    at, stop, long = edge[:-1].copy(), edge[1:].copy(), np.zeros(len(edge) - 1, np.int64)
    while len(at):
        other = before[at]
        ahead, behind = at + long, other + long
        same = (other >= 0) & (ahead < n) & (behind < n)
        same &= symbols[np.minimum(ahead, n - 1)] == symbols[np.minimum(behind, n - 1)]
        end = ~same
        lcp[rank[at[end]]] = np.where(other[end] >= 0, long[end], 0)
        at = at + end
        long = np.where(same, long + 1, np.maximum(long - 1, 0))
        alive = at < stop
        if not alive.all():
            at, stop, long = at[alive], stop[alive], long[alive]
    return lcp


def anchors(words: Words, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Rows, gram hashes, places in the row, and the first and last window (by its first word) that select it, of all anchors."""
    span = least - gram + 1
    none = np.zeros(0, np.int64)
    rows = np.flatnonzero(words.counts >= least)
    if not len(rows):
        return none, none.view(np.uint64), none, none, none
    h = window_hashes(words.hashes, gram)
    # Minima of all windows by doubling: best[i] is the place of the least of h[i:i+width], the first of equals.
    best, width = np.arange(len(h)), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(h[right] < h[left], right, left)
        width += step
    count = words.counts[rows] - least + 1
    window = spread(words.first[rows], count)
    chosen, row = best[window], np.repeat(rows, count)
    new = np.ones(len(window), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(window)) - 1
    base = words.first[row[start]]
    return row[start], h[chosen[start]], chosen[start] - base, window[start] - base, window[stop] - base


def shard(column: pa.Array, least: int = LEAST, gram: int = GRAM) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(row, first and last window of each run of repeated windows), and (row, name, place) of the anchors to be sent."""
    words = Words(column)
    long = np.flatnonzero(words.counts >= least)
    none = np.zeros(0, np.int64)
    if not len(long):
        return (none, none, none), (none, none.view(np.uint64), none)
    count = words.counts[long]
    distinct, symbol = np.unique(words.hashes[spread(words.first[long], count)], return_inverse=True)
    begin = np.cumsum(count + 1) - count - 1
    text = np.empty(int((count + 1).sum()), np.int64)
    text[spread(begin, count)] = symbol
    text[begin + count] = len(distinct) + np.arange(len(long))
    sa, rank = suffix_array(text)
    lcp = common_prefixes(text, sa, rank)
    copy = lcp >= least
    again = copy.copy()
    again[:-1] |= copy[1:]
    # again_at and copy_at by place in the text: whether the window there is repeated, and whether it isn't the first of its kind.
    again_at, copy_at = np.empty(len(text), bool), np.empty(len(text), bool)
    again_at[sa], copy_at[sa] = again, copy
    edges = np.diff(np.concatenate([[0], again_at.view(np.int8), [0]]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    which = np.searchsorted(begin, first, "right") - 1
    runs = long[which], first - begin[which], last - begin[which]
    row, name, place, low, high = anchors(words, least, gram)
    fresh = np.concatenate([[0], np.cumsum(~copy_at)])
    base = begin[np.searchsorted(long, row)]
    send = fresh[base + high + 1] > fresh[base + low]
    return runs, (row[send], name[send].view(np.int64), place[send])


def merged(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each sorted run, whether each of its names is found in another place, by binary search in the merger of all."""
    whole = np.sort(np.concatenate(runs)) if runs else np.zeros(0, np.int64)
    return [np.searchsorted(whole, run, "right") - np.searchsorted(whole, run, "left") > 1 for run in runs]


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def _sharded(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The partition's rows in tables of about size bytes of text."""
    held, total = [], 0
    for batch in batches:
        for part in pieces(batch, most=size):
            own = int(buffers(part.column("text"))[1][-1])
            if held and total + own > size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total = [], 0
            held.append(part)
            total += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def repeated(docs: DataFrame, least: int = LEAST, gram: int = GRAM, size: int = SHARD, often: int = OFTEN) -> DataFrame:
    """(doc_id, begin, end): the spans of words, from the first to before the last, that stand elsewhere too."""
    source = texts(docs).withColumn("rid", F.xxhash64("doc_id", "text"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _sharded(batches, size):
            (row, first, last), (where, name, place) = shard(table.column("text").chunk(0), least, gram)
            for rows, a, b, names in ((row, first, last, None), (where, place, None, name)):
                if len(rows):
                    at = pa.array(rows)
                    rest = [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)) if b is not None else pa.nulls(len(rows), pa.int32()), pa.array(names) if names is not None else pa.nulls(len(rows), pa.int64())]
                    yield pa.RecordBatch.from_arrays([table.column("rid").chunk(0).take(at), table.column("doc_id").chunk(0).take(at), *rest], ["rid", "doc_id", "a", "b", "name"])

    local = store(source.mapInArrow(returning(shards), "rid long, doc_id long, a int, b int, name long"), "shards")

    names = local.where("name is not null").select("rid", "a", "name")
    hot = np.sort(np.array([r.name for r in names.where(F.rand(5) < 1 / SAMPLED).groupBy("name").count().where(F.col("count") >= often).orderBy(F.desc("count"), "name").limit(HOT).collect()], np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_hot = _among(np.asarray(batch.column("name")), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(is_hot)], ["rid", "a", "name", "hot"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is None:
            return
        name, rid, a = (np.asarray(table.column(c)) for c in ("name", "rid", "a"))
        keep = np.flatnonzero(np.concatenate(merged([np.asarray(run) for run in table.column("name").chunks])))
        order = keep[np.lexsort((a[keep], rid[keep]))]
        rid, a = rid[order], a[order]
        # A row that is there many times asks once.
        new = np.ones(len(rid), bool)
        new[1:] = (rid[1:] != rid[:-1]) | (a[1:] != a[:-1])
        rid, a = rid[new], a[new]
        first = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]])) if len(rid) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rid[first]), lists(a, np.append(first, len(a)), pa.int32())], ["rid", "places"])

    found = (names if not len(hot) else (marked := names.mapInArrow(split, "rid long, a int, name long, hot boolean")).where("not hot").drop("hot")).repartition("name").mapInArrow(meet, "rid long, places array<int>")
    if len(hot):
        # A hot gram stands in several places, so it is looked up without a meeting.
        found = found.unionByName(marked.where("hot").groupBy("rid", "a").count().select("rid", F.array("a").alias("places")))
    found = found.groupBy("rid").agg(F.flatten(F.collect_list("places")).alias("places"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            # Two of a task's equal rows show that they are repeated; the others would say the same.
            again = np.zeros(batch.num_rows, bool)
            for i, rid in enumerate(batch.column("rid").to_pylist()):
                seen[rid] = times = seen.get(rid, 0) + 1
                again[i] = times > 2
            if again.any():
                batch = batch.filter(pa.array(~again))
            for part in pieces(batch):
                words = Words(part.column("text"))
                row, name, place, low, high = anchors(words, least, gram)
                asked = part.column("places")
                which = np.repeat(np.arange(len(asked)), np.diff(np.asarray(asked.offsets)))
                # Flattening drops what the slice leaves out.
                wanted = np.unique((which << 32) | np.asarray(asked.flatten()).astype(np.int64))
                hit = np.flatnonzero(np.isin((row << 32) | place, wanted, assume_unique=False))
                if not len(hit):
                    continue
                whole = window_hashes(words.hashes, least)
                count = high[hit] - low[hit] + 1
                flat = whole[spread(words.first[row[hit]] + low[hit], count)].view(np.int64)
                key, at, begin = name[hit].view(np.int64), row[hit], low[hit]
                hot = _among(key, sent.value)
                if hot.any():
                    # The windows at a hot gram go each by its own hash.
                    alone = np.repeat(hot, count)
                    begin = np.concatenate([begin[~hot], spread(low[hit][hot], count[hot])])
                    at = np.concatenate([at[~hot], np.repeat(at[hot], count[hot])])
                    key = np.concatenate([key[~hot], flat[alone]])
                    flat = np.concatenate([flat[~alone], flat[alone]])
                    count = np.concatenate([count[~hot], np.ones(int(alone.sum()), np.int64)])
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column("rid").take(at), part.column("doc_id").take(at), pa.array(begin.astype(np.int32)), lists(flat, np.concatenate([[0], np.cumsum(count)]), pa.int64())], ["key", "rid", "doc_id", "a", "windows"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is None:
            return
        runs = table.column("windows").chunks
        count = np.concatenate([np.diff(np.asarray(run.offsets)) for run in runs])
        again = np.concatenate(merged([np.asarray(run.flatten()) for run in runs]))
        table = table.select(["rid", "doc_id", "a"]).combine_chunks()
        owner = np.repeat(np.arange(len(count)), count)
        start = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.asarray(table.column("a")), count)
        fresh = again.copy()
        fresh[1:] &= ~(again[:-1] & (owner[1:] == owner[:-1]))
        end = again.copy()
        end[:-1] &= ~(again[1:] & (owner[1:] == owner[:-1]))
        at = pa.array(owner[fresh])
        yield pa.RecordBatch.from_arrays([table.column("rid").chunk(0).take(at), table.column("doc_id").chunk(0).take(at), pa.array(start[fresh].astype(np.int32)), pa.array(start[end].astype(np.int32))], ["rid", "doc_id", "a", "b"])

    looked = source.join(found, "rid").select("rid", "doc_id", "text", "places").mapInArrow(returning(look), "key long, rid long, doc_id long, a int, windows array<long>")
    # A row that is there twice is asked twice and would seem to repeat itself in equal places: it does, as the two rows do.
    across = looked.repartition("key").mapInArrow(returning(merge), "rid long, doc_id long, a int, b int")
    runs = local.where("name is null").select("rid", "doc_id", "a", "b").unionByName(across)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column("runs")
            first = np.asarray(got.offsets) - int(got.offsets[0].as_py())
            flat = got.flatten()
            a, b = np.asarray(flat.field("a")).astype(np.int64), np.asarray(flat.field("b")).astype(np.int64) + least
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            order = np.lexsort((a, row))
            row, a, b = row[order], a[order], b[order]
            wide = int(b.max(initial=0)) + 2
            reach = np.maximum.accumulate(b + row * wide)
            new = np.ones(len(a), bool)
            new[1:] = (a + row * wide)[1:] > reach[:-1]
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(a)) - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[head])), pa.array(a[head]), pa.array(reach[tail] - row[tail] * wide)], ["doc_id", "begin", "end"])

    grouped = runs.groupBy("rid", "doc_id").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    out = store(grouped.mapInArrow(spans, "doc_id long, begin long, end long"), "spans")
    discard(local)
    return out


def sql(least: int = LEAST) -> str:
    """DuckDB SQL with the rows of repeated() over documents."""
    split = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z_\x{80}-\x{10ffff}]+')"
    return f"""
        WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, text, {split} AS w FROM documents),
        windows AS (SELECT r, doc_id, text, s - 1 AS s, md5(array_to_string(w[s:s + {least} - 1], ' ')) AS g
            FROM (SELECT r, doc_id, text, w, unnest(range(1, len(w) - {least} + 2)) AS s FROM rows_ WHERE len(w) >= {least})),
        again AS (SELECT r, doc_id, text, s FROM windows JOIN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1) USING (g)),
        cuts AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= {least} THEN 0 ELSE 1 END AS cut FROM again),
        islands AS (SELECT *, sum(cut) OVER (PARTITION BY r ORDER BY s) AS k FROM cuts),
        spans AS (SELECT r, doc_id, text, k, min(s) AS begin, max(s) + {least} AS "end" FROM islands GROUP BY ALL)
        SELECT DISTINCT ON (doc_id, hash(text), begin, "end") doc_id, begin::BIGINT AS begin, "end"::BIGINT AS "end" FROM spans"""
