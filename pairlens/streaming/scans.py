"""Incremental scans of a stream of files: each micro-batch goes through the batch plan once per content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ScanConfig
from ..operators.units import extract_units
from ..plans.scan import scan


def scan_stream(files: DataFrame, corpus: DataFrame, results: str, checkpoint: str, config: ScanConfig | None = None, once: bool = True, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Scan files as they arrive and append findings to the Parquet table ``results``.

    ``files`` is a streaming frame of ``path, content``.  A unit whose content was scanned under
    the same settings is left out; findings carry the function's hash, by which reports join.
    A batch that is run again after a failure replaces its own folder, so nothing counts twice.
    No watermark is needed: keys are contents, not times.
    """
    config = config or ScanConfig()
    mark = config.fingerprint()

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{results}/settings={mark[:16]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/done")
        seen = spark.read.parquet(f"{target}/done") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
        rows = batch.select("path", F.col("content").cast("string").alias("content")).dropDuplicates(["path"])
        hashes = extract_units(rows).select("path", "function_hash")
        if seen is not None:
            known = seen.where(F.col("batch") != number).select("function_hash").distinct()
            fresh = hashes.join(known, "function_hash", "left_anti").select("path").distinct()
            rows = rows.join(fresh, "path", "left_semi")
        found = scan(rows, corpus, config)
        found.write.mode("overwrite").parquet(f"{target}/findings/batch={number}")
        hashes.select("function_hash").distinct().write.mode("overwrite").parquet(f"{target}/done/batch={number}")
        if after:
            after(found, number)

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
