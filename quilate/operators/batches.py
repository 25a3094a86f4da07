"""Columns measured in Arrow batches, with functions on whole arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Bytes of the measured columns that are worked on at once (or one row).
SLICE = 4 << 20

#: An array to arrays of the same length by name, and the types of these.
Measure = tuple[Callable[[pa.Array], dict[str, object]], dict[str, str]]


def slices(batch: pa.RecordBatch, columns: list[int], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of about ``limit`` bytes in the given columns."""
    parts = max(1, min(batch.num_rows, -(-sum(batch.column(i).nbytes for i in columns) // limit)))
    for own in np.array_split(np.arange(batch.num_rows), parts):
        if len(own):
            yield batch.slice(int(own[0]), len(own))


def measured(df: DataFrame, measures: dict[str, Measure]) -> DataFrame:
    """``df`` with each column of ``measures`` replaced by what its function makes of it."""
    kept, at = [c for c in df.columns if c not in measures], {c: i for i, c in enumerate(df.columns)}
    more = ", ".join(f"`{name}` {kind}" for _, types in measures.values() for name, kind in types.items())
    schema = StructType([*[df.schema[c] for c in kept], *StructType.fromDDL(more).fields])
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields[len(kept) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, [at[c] for c in measures]):
                found = {n: x for c, (work, _) in measures.items() for n, x in work(part.column(at[c])).items()}
                yield pa.RecordBatch.from_arrays([*[part.column(at[c]) for c in kept], *[pa.array(found[n], t) for n, t in arrow]], schema.names)

    return df.mapInArrow(run, schema)


def per_distinct(values: pa.Array, *tests: Callable[[str], bool]) -> list[np.ndarray]:
    """Tests of strings, each distinct one tested once; nulls pass none."""
    coded = values.dictionary_encode()
    codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_pylist()
    return [np.array([*map(test, words), False], bool)[codes] for test in tests]
