"""What the training-data operators share: input columns, written tables, sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_written: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, doc_id and text; a null text counts as empty, other columns go."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def mapped(df: DataFrame, run, schema: str, whole: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """df.mapInPandas(run, schema), with the columns named in whole as strings while they are in pandas, which makes floats of whole numbers
    beside nulls and rounds those beyond 2^53. schema has the other columns; those in whole come before them as they were in df."""
    sent = df.withColumns({c: F.col(c).cast("string") for c in whole})
    made = sent.mapInPandas(run, ", ".join([*[f"`{c}` string" for c in whole], *([schema] if schema else [])]))
    return made.withColumns({c: F.col(c).cast(df.schema[c].dataType) for c in whole})


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; one of our own where it is unset and driver and executors are one
    process. On a cluster an unset folder is an error: executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, schema=None, codec: str = "snappy") -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: the lineage is cut and lost
    executors cost nothing but a reread."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _written.append((spark, path))
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._gridloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_gridloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before us
            return


def spread_join(many: DataFrame, one: DataFrame, on: list[str], how: str = "left", hot: int = 1000) -> DataFrame:
    """many joined with one, which has a row for each value of on at most. Values with more than one in hot of many's rows are fewer than
    hot, so their rows of one are broadcast, and the others of many are shuffled without a large group. many should be a written table."""
    counts = written(many.groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 64"))
    n = many.count()
    crowded = counts.where(F.col("_n") > max(64, n // hot)).select(*on).limit(hot)  # no more can be
    named = written(one.join(F.broadcast(crowded), on, "left_semi"))
    rest = many.join(F.broadcast(crowded), on, "left_anti").join(one.hint("shuffle_merge"), on, how)
    found = many.join(F.broadcast(crowded), on, "left_semi").join(F.broadcast(named), on, how)
    return rest.unionByName(found)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, row_bytes: int, max_mb: int = 16) -> bool:
    """Whether a written table of rows of row_bytes fits a broadcast of max_mb; counts at most one row more."""
    most = max_mb * 1_000_000 // row_bytes
    return df.limit(most + 1).count() <= most


def sized_join(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int, max_mb: int = 16) -> DataFrame:
    """Broadcasts right where its size has been checked, and shuffles both sides by key otherwise."""
    if small(right, row_bytes, max_mb):
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("shuffle_merge"), on, how)
