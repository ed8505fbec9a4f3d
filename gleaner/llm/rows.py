"""Python functions over the rows of a DataFrame, in small pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PIECE_BYTES = 2 << 20
_WHOLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}


def mapped(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType | str) -> DataFrame:
    """Like ``mapInPandas``, but ``function`` sees at most about ``PIECE_BYTES`` at once, so whole
    batches of long texts never become Python strings together; integers stay integers beside nulls."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            step = max(1, b.num_rows * PIECE_BYTES // max(b.nbytes, 1))
            for at in range(0, b.num_rows, step):
                yield b.slice(at, step).to_pandas(types_mapper=_WHOLE.get)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function(pieces(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(run, kind)
