"""Folds in order: rows of a key stream through one task, sorted, with only the fold's own state in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


class Fold(Protocol):
    def row(self, *values) -> Iterable[tuple]:
        """What comes out at this row."""


def in_order(df: DataFrame, key: str, order: list[Column], values: list[str], start: Callable[[], Fold], fields: str) -> DataFrame:
    """(key, fields) of what a new fold for each key makes of the key's rows, which it gets in order as their `values`. A null key is a key."""
    kind = df.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, {fields}"
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], out).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fold = object(), None
        for batch in batches:
            rows = []
            for k, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fold is None or k != at:
                    at, fold = k, start()
                rows += [(k, *found) for found in fold.row(*rest)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema.names)

    dealt = df.repartition(F.col(key)).sortWithinPartitions(F.col(key).asc(), *order)
    return dealt.select(key, *values).mapInArrow(run, out)
