"""Plain Python functions as Arrow-batched column functions; null in, null out."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def column(f: Callable, kind: str = "string") -> Callable[..., Column]:
    """f over values as a function over columns (or their names) that returns `kind`."""

    def run(*series: pd.Series) -> pd.Series:
        rows = zip(*series, strict=True)
        return pd.Series([None if any(x is None or x is pd.NA or x != x for x in row) else f(*row) for row in rows], dtype=object)

    run.__annotations__ = {"return": pd.Series}
    batched = F.pandas_udf(run, kind, functionType=200)  # scalar
    return lambda *columns: batched(*(F.col(c) if isinstance(c, str) else c for c in columns))


def table(df, keys: list[str], columns: list[str], f: Callable, fields: str):
    """keys and fields: a row for each tuple that f(*columns) lists, in Arrow batches; null is the empty text."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    own = _parse_datatype_string(fields)
    schema = StructType([*(df.schema[k] for k in keys), *own.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = [part.column(len(keys) + i).to_pylist() for i in range(len(columns))]
                found = [f(*("" if x is None else x for x in row)) for row in zip(*values, strict=True)]
                owner = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
                cells = list(zip(*(r for rows in found for r in rows), strict=True)) or [()] * len(own.fields)
                arrays = [part.column(i).take(owner) for i in range(len(keys))]
                arrays += [pa.array(c, arrow.field(len(keys) + i).type) for i, c in enumerate(cells)]
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return df.select(*keys, *columns).mapInArrow(run, schema)
