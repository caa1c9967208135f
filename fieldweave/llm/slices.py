"""Python over a plan's rows in small frames, so that a worker never holds a whole batch as objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 512

Frames = Iterator[pd.DataFrame]


def map_slices(df: DataFrame, f: Callable[[Frames], Frames], schema: str, rows: int = ROWS) -> DataFrame:
    """``df.mapInPandas(f, schema)`` with frames of at most ``rows`` rows."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def small() -> Frames:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows).to_pandas()

        for frame in f(small()):
            if len(frame):
                yield from pa.Table.from_pandas(frame, schema=out, preserve_index=False).to_batches()

    return df.mapInArrow(run, schema)
