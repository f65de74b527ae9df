"""Content-addressed snapshots of tables behind a pointer, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def content_id(df: DataFrame) -> str:
    """Twenty hex digits that depend on columns and rows, not on their order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("s"))
    text = F.concat_ws("|", F.lit(",".join(sorted(df.columns))), F.col("n").cast("string"), F.coalesce(F.col("s").cast("string"), F.lit("")))
    return row.select(F.substring(F.sha2(text, 256), 1, 20)).first()[0]


def publish(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write a snapshot, check its rows, then let the pointer name it; an empty one is refused and the old one stays.

    A snapshot that is there already is used again.
    """
    spark = df.sparkSession
    name = content_id(df)
    rows = df.count()
    if not rows:
        raise ValueError("an empty snapshot is not published")
    final, fs = _path(spark, f"{root}/snapshots/{name}")
    if not fs.exists(final):
        staged, _ = _path(spark, f"{root}/staged/{name}")
        df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(staged.toString())
        if spark.read.parquet(staged.toString()).count() != rows:
            raise ValueError("the staged snapshot is not whole")
        fs.mkdirs(final.getParent())
        fs.rename(staged, final)
    pointer, new = _path(spark, f"{root}/CURRENT")[0], _path(spark, f"{root}/CURRENT.new")[0]
    out = fs.create(new, True)
    out.write(bytearray(name.encode()))
    out.close()
    fs.delete(pointer, False)
    fs.rename(new, pointer)
    return name


def current(spark: SparkSession, root: str) -> str | None:
    pointer, fs = _path(spark, f"{root}/CURRENT")
    if not fs.exists(pointer):
        return None
    return spark.read.text(pointer.toString()).first()[0]


def load(spark: SparkSession, root: str) -> DataFrame | None:
    """The published snapshot, or None."""
    name = current(spark, root)
    return spark.read.parquet(f"{root}/snapshots/{name}") if name else None


def replace(spark: SparkSession, staged: str, final: str) -> None:
    """Let a whole folder take another's place; what was there before goes last."""
    new, fs = _path(spark, staged)
    target, old = _path(spark, final)[0], _path(spark, final.rstrip("/") + ".old")[0]
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(new, target)
    fs.delete(old, True)


def cached(build, root: str, *made_of: DataFrame) -> DataFrame:
    """A table kept under the contents of what it is made of: read if it is there and whole, else ``build()`` is written."""
    spark = made_of[0].sparkSession
    path = f"{root}/index-{'-'.join(content_id(df) for df in made_of)}"
    done, fs = _path(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
