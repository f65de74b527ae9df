"""Row-wise Python over Arrow batches: records in, records out, in slices that bound memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def flat_map(df: DataFrame, function: Callable[[dict], Iterable[dict]], schema: str | T.StructType, rows: int = 256) -> DataFrame:
    """Each row, as a dict, to any number of dicts; keys that are left out become null."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = [x for r in batch.slice(at, rows).to_pylist() for x in function(r)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, kind)


def halving(run: Callable[[list], list], items: list, size: int, exhausted: tuple = (MemoryError,)) -> list:
    """``run`` over slices of at most ``size``; a slice that exhausts memory is tried again in halves, down to one item.

    The smaller size stays for what follows.  Other errors, and one item that is too much, are raised.
    """
    out, at = [], 0
    while at < len(items):
        try:
            out += run(items[at : at + size])
        except exhausted:
            size = min(size, len(items) - at)
            if size == 1:
                raise
            size //= 2
            continue
        at += size
    return out
