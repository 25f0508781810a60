"""Running state over the ordered rows of a group, where no window function has it: linear in the rows, a batch held at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def fold_ordered(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable[..., object]], name: str, kind: str) -> DataFrame:
    """``rows`` (narrow ones: all columns pass through Python) with column ``name`` of type ``kind``.

    ``start`` makes a group's step, which takes each row's columns other than ``keys`` in the order of ``order`` and
    returns its value.
    """
    n, columns = len(keys), [*keys, *(c for c in rows.columns if c not in keys)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, step = None, start()
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != group:
                    group, step = row[:n], start()
                out.append(step(*row[n:]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string() if kind == "string" else pa.int32())], [*columns, name])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(each, f"{schema}, `{name}` {kind}")
