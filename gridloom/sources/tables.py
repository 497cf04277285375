"""Readers of the tables, and tables kept in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """df written once in the folder that spark.checkpoint.dir names, and read back. Where that is unset, a folder of our own if driver and
    executors are one process; on a cluster that is an error, as executors would write to their own disks."""
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    path = f"{place}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_table = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of kept() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_gridloom_table", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before us
            return


def split_corrupt(rows: DataFrame, column: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON text fits schema, with it in doc, and the others; null text counts as corrupt."""
    named = StructType([*schema.fields]).add("_corrupt", StringType())
    read = rows.withColumn("doc", F.from_json(column, named, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("doc").isNull() | F.col("doc._corrupt").isNotNull()
    return read.where(~bad).withColumn("doc", F.col("doc").dropFields("_corrupt")), read.where(bad).drop("doc")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSONL manifest: path, sha256, bytes, and fault (null where the line is right)."""
    lines = spark.read.schema("path string, sha256 string, bytes long, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    fault = F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(F.col("path").isNull() | (F.col("path") == ""), "path").when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "sha256").when(F.coalesce(F.col("bytes"), F.lit(-1)) < 0, "bytes")
    return lines.withColumn("fault", fault).drop("_corrupt_record")


def write_manifest(rows: DataFrame, path: str) -> None:
    """path, sha256, bytes as JSON lines in the order of paths; repeated paths are an error."""
    if not rows.groupBy("path").count().where("count > 1").isEmpty():
        raise ValueError("a path occurs twice")
    rows.select("path", "sha256", "bytes").sort("path").write.json(path)


def kind_of(content: str = "content"):
    """The kind of a binary file by its first bytes; null where unknown."""
    head = F.hex(F.substring(F.col(content), 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304"), "zip")
        .when(head.startswith("676C5446"), "glb")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    )
