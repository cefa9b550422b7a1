"""mapInArrow with whole texts in slices, other columns carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.kernels import slices
from tessera.llm.store import ship


def add_columns(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list]],
    keep: list[str] | None = None,
    most: int = 1 << 20,
) -> DataFrame:
    """``df`` (or its ``keep`` columns) with the columns that ``make()(texts)`` computes from ``column``.

    A column of ``df`` that has the name of a new one is replaced.  ``make`` runs
    once a task, so what it builds is shared by the task's slices.
    """
    ship(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    read = kept if column in kept else [*kept, column]
    # Under way columns have plain names: those of a table may hold any character.
    source = df.select(*[df[f"`{c.replace('`', '``')}`"].alias(f"c{i}") for i, c in enumerate(read)])
    at, inner = read.index(column), [f"c{i}" for i in range(len(kept))]
    schema = T.StructType([*(T.StructField(i, source.schema[i].dataType) for i in inner), *(T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields))])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, f"c{at}", most):
                made = compute(part.column(at))
                cols = [part.column(i) for i in range(len(inner))]
                cols += [x if isinstance(x, pa.Array) else pa.array(x, types.field(f"n{i}").type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([c.cast(types.field(i).type) for i, c in enumerate(cols)], schema=types)

    return source.mapInArrow(run, schema).toDF(*kept, *(f.name for f in fields))
