"""Arrow passes that keep all columns of a table: filter rows by their text, or replace the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from boxtrail.llm.flat import SLICE_BYTES, slices
from boxtrail.session import ship_package


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filter_rows(documents: DataFrame, text: str, test: Callable[[pa.Array], pa.Array], limit: int = SLICE_BYTES) -> DataFrame:
    """Rows whose text passes ``test`` (texts in, booleans out), every column as it was."""
    ship_package(documents.sparkSession)
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, limit):
                yield part.filter(test(part.column(at)))

    return documents.mapInArrow(run, documents.schema)


def replace_text(documents: DataFrame, text: str, change: Callable[[list[str]], list[str | None]], limit: int = SLICE_BYTES) -> DataFrame:
    """The same rows with the text changed; null stays null."""
    ship_package(documents.sparkSession)
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, limit):
                column = part.column(at)
                texts = column.to_pylist()
                new = change([t or "" for t in texts])
                new = pa.array([None if t is None else n for t, n in zip(texts, new, strict=True)], column.type)
                yield pa.RecordBatch.from_arrays([new if k == at else part.column(k) for k in range(part.num_columns)], schema=part.schema)

    return documents.mapInArrow(run, documents.schema)
