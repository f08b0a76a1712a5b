"""Readers: parquet tables, JSON pages, binary files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_id(df: DataFrame, ident: int, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == ident)


def look_up(asked: DataFrame, rows: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(found, missing) of rows asked for by key (once each): the rows, and a record (key, error) for each that is not there."""
    asked = asked.select(key).distinct()
    missing = asked.join(rows.select(key), key, "left_anti")
    return rows.join(asked, key, "left_semi"), missing.withColumn("error", F.concat(F.lit("not found: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))


def pages_of_text(spark: SparkSession, path: str) -> DataFrame:
    """Files of form-feed separated page text as rows (path, page_no, text)."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("t"))
    return raw.select("path", F.posexplode(F.split("t", "\f"))).select("path", (F.col("pos") + 1).alias("page_no"), F.col("col").alias("text"))


def needs_ocr(text, least: int = 100):
    """A page whose native text is this short or shorter has to be read optically."""
    return F.length(strip(F.coalesce(text, F.lit("")))) <= least


def accepted_text(text, least: int = 50):
    """Whether the text of a file, without white space at its ends, is long enough to go on."""
    return F.length(strip(F.coalesce(text, F.lit("")))) >= least


def join_pages(pages: DataFrame) -> DataFrame:
    """One text per path: each non-empty page under its header, in page order."""
    block = F.concat(F.lit("--- Página "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.col("text"))
    full = pages.filter(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page_no", block.alias("b")))).alias("p"))
    return full.select("path", F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("text"))
