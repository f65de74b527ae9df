"""Helpers shared by the operators: table reading, the shared folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..plans.scratch import claim as scratch_path
from ..plans.scratch import claimed, materialise, release, shared_dir

__all__ = ["claimed", "materialise", "read_table", "release", "scratch_path", "shared_dir", "slices", "utf8"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text that one step works on at once; a longer single text has a step to itself.
SLICE_BYTES = 8 << 20


def slices(batches, rows: int, text: int | None = None) -> Iterator:
    """Cut Arrow batches so that what one step holds in memory stays small: by rows, and by the bytes of column ``text``."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        upto = np.zeros(n + 1, dtype=np.int64)
        if text is not None and n:
            upto[1:] = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            end = max(at + 1, min(at + rows, int(np.searchsorted(upto, upto[at] + SLICE_BYTES, "right")) - 1)) if text is not None else min(at + rows, n)
            yield batch.slice(at, min(end, n) - at)
            at = end


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of a string column; null reads as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
