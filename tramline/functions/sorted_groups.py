"""Per-group Python over sorted partitions: one Python call a group, without a data frame for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def by_group(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of fold(rows of one group, in order) for each group. One shuffle on keys; the rows of a group are held in memory."""
    own = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}
    types = [kinds[x.strip().split(" ")[1]] for x in schema.split(",")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if held and key != current:
                    out += fold(held)
                    held = []
                    if len(out) >= 10_000:
                        yield packed(out)
                        out = []
                current = key
                held.append(row)
        if held:
            out += fold(held)
        if out:
            yield packed(out)

    return own.mapInArrow(run, schema)
