"""A function of the caller's over rows, in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.sources.storage import ship


def map_items(df: DataFrame, function: Callable[[dict], dict], schema: str) -> DataFrame:
    """``function`` of every row (a dict) as a row of ``schema``, in Arrow batches; for what no expression can say."""
    ship(df.sparkSession)
    kind = T._parse_datatype_string(schema)
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for b in batches:
            rows = [function(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], arrow.field(n).type) for n in names], names=names)

    return df.mapInArrow(run, kind)
