"""Running a function over the texts of a table, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: In the result of a text function: for each output row the number of its text.
ROW = "_row"
#: Texts that stand side by side in a worker's memory.
ROWS = 1000


def map_texts(docs: DataFrame, keep: dict[str, str], text_col: str, make: Callable[[], Callable[[list[str]], dict]], fields: str) -> DataFrame:
    """``keep`` (new name -> column) and ``fields`` that a function gives for the texts.

    ``make()`` gives each task its function of a list of texts (null as empty)
    to columns; with a ROW column it may give several rows for a text, or none.
    Kept columns pass as they are, so null and large ids stay exact.
    """
    rows = docs.select(*[F.col(f"`{c}`").alias(name) for name, c in keep.items()], F.col(f"`{text_col}`").alias("_text"))
    more = StructType.fromDDL(fields)
    names = list(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(more)
        function = make()
        parts = (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))
        for batch in parts:
            out = function([t or "" for t in batch.column(len(names)).to_pylist()])
            kept = [batch.column(i) for i in range(len(names))]
            if ROW in out:
                at = pa.array(out[ROW], pa.int64())
                kept = [c.take(at) for c in kept]
            added = [pa.array(out[f.name], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([*kept, *added], names=[*names, *kinds.names])

    schema = StructType([*rows.drop("_text").schema.fields, *more.fields])
    return rows.mapInArrow(run, schema)
