"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir, as in local tests.
LOCAL_WORK_DIR = "/tmp/checkpoints/geoloom"

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the cluster names it; a local one for local sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or LOCAL_WORK_DIR).rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    This cuts the lineage at a table every executor can read again, so a lost
    executor costs its running tasks only. Values drawn per row, such as row
    numbers, are fixed from here on.
    """
    path = f"{work_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_path = path
    return made


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """As `written`, laid out in buckets of key: joins on key do not shuffle this side, however many there are."""
    spark = df.sparkSession
    name, pieces = f"{label}-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = f"{work_dir(spark)}/{name}", name.replace("-", "_")
    df.repartition(pieces, key).write.bucketBy(pieces, key).option("path", path).saveAsTable(table)
    made = spark.table(table)
    made.written_path, made.table_name = path, table
    return made


def dropped(table: DataFrame) -> None:
    """Removes a table made by `written` or `bucketed`, once all that was made from it is written itself."""
    if "table_name" in vars(table):
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.table_name}")
    jvm, path = table.sparkSession._jvm, table.written_path
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 512, bytes_: str = "32m") -> None:
    """Holds Arrow batches to so few rows and bytes that very long texts fit in a worker, for the rest of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bytes_)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_text(name: str = "doc_id") -> Column:
    """An id as text, for Arrow batches: pandas turns longs that stand beside nulls into doubles, which do not hold them all."""
    return F.col(name).cast("long").cast("string")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for an empty text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def ordered_key(number: Column) -> Column:
    """Fixed-width text that sorts as the signed long does; null sorts first."""
    flipped = F.hex(number.cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long")))
    return F.coalesce(F.lpad(flipped, 16, "0"), F.lit(""))
