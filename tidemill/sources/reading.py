"""Responses that Python reads, in slices, so that a worker's memory holds the rows of a slice and not those of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: Responses that are parsed before their rows leave the Python worker.
SLICE = 128


def texts(values: list[str | None]) -> pa.Array:
    """An array of texts; what UTF-8 has no bytes for (half a surrogate pair, out of JSON) becomes a question mark."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode(errors="replace").decode() for v in values], pa.string())


def listed(rows: list[list[dict] | None], fields: tuple[str, ...]) -> pa.Array:
    """An array of each response's rows (null of one that has none to read)."""
    flat, offsets = [r for some in rows for r in some or ()], [0]
    for some in rows:
        offsets.append(offsets[-1] + len(some or ()))
    each = pa.StructArray.from_arrays([texts([r.get(f) for r in flat]) for f in fields], fields)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each, mask=pa.array([some is None for some in rows]))


def with_read(pages: DataFrame, reader: str, skip: list[str], asked: tuple[str, ...], read: Callable[[dict[str, list]], list[pa.Array]], made: str) -> DataFrame:
    """pages with the columns (made) that read() makes of a slice's asked columns.

    reader: the column that says what reads a body. The bodies of those in skip stay, for built-in functions; of
    the others, nothing more is needed.
    """
    held = [StructField(f.name, f.dataType) for f in pages.schema.fields]  # a body may be null now
    schema = StructType(held + pages.sparkSession.createDataFrame([], made).schema.fields)
    names, body = schema.names, pages.columns.index("body")
    places = {name: pages.columns.index(name) for name in {*asked, reader, "body"}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                columns = batch.slice(start, SLICE).columns
                slices = {name: columns[at].to_pylist() for name, at in places.items()}
                found = read(slices)
                kept = [b if n in skip else None for n, b in zip(slices[reader], slices["body"], strict=True)]
                columns[body] = pa.array(kept, columns[body].type)
                yield pa.RecordBatch.from_arrays([*columns, *found], names)

    return pages.mapInArrow(run, schema)
