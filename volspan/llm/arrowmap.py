"""Run a function over the texts of a table in bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: A slice given to the function holds at most this many text bytes, or one row.
SLICE_BYTES = 512 << 10


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def byte_lengths(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most `most` bytes in `column`, or one row."""
    start, held = 0, 0
    for i, n in enumerate(byte_lengths(batch.column(column))):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def append_struct(
    df: DataFrame,
    text_col: str,
    out: str,
    dtype: StructType,
    fn: Callable[[pa.Array], Sequence[pa.Array]],
    keep: Sequence[str] | None = None,
    finish: Callable[[], None] | None = None,
) -> DataFrame:
    """`keep` columns of `df` (default: all) and a struct column `out` made from the texts.

    `fn` gets the texts of a slice and returns one Arrow array for each field of
    `dtype`. As with `withColumn`, `out` replaces a column of the same name. `finish` runs when
    a task has seen its last text: workers are reused, so what it kept would stay.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    source = df.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(text_col)).cast("string").alias("text to map"))
    schema = StructType([*source.schema.fields[: len(kept)], StructField(out, dtype)])
    arrow_type = to_arrow_type(dtype)
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, n):
                    made = [pa.array(a, f.type) if not isinstance(a, (pa.Array, pa.ChunkedArray)) else a for a, f in zip(fn(part.column(n)), arrow_type, strict=True)]
                    struct = pa.StructArray.from_arrays(made, fields=list(arrow_type))
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], struct], names=[*kept, out])
        finally:
            if finish is not None:
                finish()
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    return df.mapInArrow(fn, schema)
