"""Helpers that the training-data operators share: tables, shared folder, written cut points."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six characters that separate words everywhere in this subpackage: space, \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
#: Java and Python pattern of a run of separators.
GAP = r"[\x20\x09-\x0D]+"
#: Java and Python pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (local tests), a folder of this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="mnemo-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and the files survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/mnemo-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mnemo_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written() table that no pending result reads."""
    spark, path = df.sparkSession, df._mnemo_path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_of(col: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def fold_of(id_col: str, parts: int):
    """crc32 of the id as text, modulo parts; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def first_of_repeats(rows: DataFrame, again: DataFrame, same) -> DataFrame:
    """rows, but of those that meet one row of `again` only the one with the least hash of all columns."""
    names = [f"`{c}`" for c in rows.columns]
    if not again.take(1):
        return rows
    once = Window.partitionBy(*again.columns).orderBy(F.xxhash64(*[F.col(c) for c in names]))
    repeated = rows.join(again, same).withColumn("__at", F.row_number().over(once)).where("__at = 1").select(*names)
    return rows.join(again, same, "left_anti").unionByName(repeated)
