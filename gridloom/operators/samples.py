"""Samples of a data set as files of splits, with their manifest and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import SPLITS, hash_split
from .keyed import zero_filled

#: Names of a sample's files, what its id may be, and bytes of a data set; fixed values.
FILES, ID, MOST_BYTES = ("image.png", "walls.png", "objects.json", "meta.json"), r"\A[A-Za-z0-9][A-Za-z0-9_-]{0,127}\z", 8_589_934_592


def files(samples: DataFrame) -> DataFrame:
    """split, sample, path, sha256, bytes of the files of samples (sample, group, and a text or binary column for each of FILES, with _ for the dot): one for each that is
    not null, in the split of the group, so that a group is never in two. A sample without a group is in no split and has no file."""
    has = [F.struct(F.lit(name).alias("name"), F.col(name.replace(".", "_")).cast("binary").alias("data")) for name in FILES]
    rows = samples.withColumn("split", hash_split(F.col("group"))).where("split is not null").select("split", "sample", F.inline(F.array(*has))).where("data is not null")
    return rows.select("split", "sample", F.concat_ws("/", "split", "sample", "name").alias("path"), F.sha2("data", 256).alias("sha256"), F.octet_length("data").cast("long").alias("bytes"))


def counts(found: DataFrame) -> DataFrame:
    """split, n_samples, n_files, bytes of files(); every split is there, 0 where it is empty."""
    n = found.groupBy("split", "sample").agg(F.count("*").alias("f"), F.sum("bytes").alias("b"))
    n = n.groupBy("split").agg(F.count("*").alias("n_samples"), F.sum("f").alias("n_files"), F.sum("b").alias("bytes"))
    asked = found.sparkSession.createDataFrame([(s,) for s, _ in SPLITS], "split string")
    return zero_filled(asked, n, "split", ["n_samples", "n_files", "bytes"])


def checked(found: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """files() after a look at them: an id that makes no path, a path that occurs twice, or more bytes in all than most is an error."""
    if not found.where(F.col("sample").isNull() | ~F.col("sample").rlike(ID)).isEmpty():
        raise ValueError("a sample's id is not a name")
    if not found.groupBy("path").count().where("count > 1").isEmpty():
        raise ValueError("a path occurs twice")
    if (found.agg(F.sum("bytes")).first()[0] or 0) > most:
        raise ValueError("the data set is too large")
    return found
