"""Arrow batches of source files: what depends on a text alone is read once for each distinct text of a batch.

A file's path is put to the rows of its text in Arrow, so equal files (copies of a folder, vendored modules) cost no more Python than
one of them, and no rows become pandas objects. Nothing is kept from one batch to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that goes back to Spark.
ROWS = 1000


def rows_by_text(files: DataFrame, path: str, fields: str, read: Callable[[str], Iterable[dict]]) -> DataFrame:
    """``path`` (a name) and ``fields`` (columns with types): the rows ``read(text)`` of each of ``files(path, text)``. A null text
    counts as empty."""
    own = to_arrow_schema(StructType.fromDDL(fields))
    kind = pa.struct(list(own))

    def run(batches):
        for b in batches:
            coded = b.column("text").fill_null("").dictionary_encode()
            found = [list(read(t)) for t in coded.dictionary.to_pylist()]
            rows = pa.array([r for rows in found for r in rows], kind)
            n = np.array([len(rows) for rows in found], np.int64)
            begin, code = np.cumsum(n) - n, coded.indices.to_numpy()
            of = np.repeat(np.arange(len(code)), n[code])
            place = np.arange(len(of)) - np.repeat(np.cumsum(n[code]) - n[code] - begin[code], n[code])
            for i in range(0, len(of), ROWS):
                part = slice(i, i + ROWS)
                yield pa.RecordBatch.from_arrays([b.column("path").take(pa.array(of[part])), *rows.take(pa.array(place[part])).flatten()], names=[path, *own.names])

    return files.select("path", "text").mapInArrow(run, f"{path} string, {fields}")
