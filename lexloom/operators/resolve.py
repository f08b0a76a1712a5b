"""References to norms: a left equi-join on three keys, first match by default order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.functions.text import normal_reference


def resolve(refs: DataFrame, norms: DataFrame, own: str = "norma_id", lenient: bool = False) -> DataFrame:
    """Adds target_norm_id. Kinds match whatever the case, numbers exactly, years as integers.

    A self reference points to the clause's own norm. ``lenient`` also maps kind
    synonyms and ignores separators in numbers.
    """
    tipo, numero = (normal_reference(F.col("law_tipo"), F.col("law_numero")) if lenient else (F.col("law_tipo"), F.col("law_numero")))
    first = W.partitionBy("_t", "_n", "_y").orderBy(F.col("ano").desc(), F.col("numero").desc(), F.col("id"))
    right = norms.select(F.lower("tipo").alias("_t"), F.col("numero").alias("_n"), F.col("ano").alias("_y"), "id", "ano", "numero")
    right = right.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select("_t", "_n", "_y", F.col("id").alias("_found"))
    left = refs.withColumn("_t", F.lower(tipo)).withColumn("_n", numero).withColumn("_y", F.expr("try_cast(law_ano as int)"))
    # A reference that lacks a key meets no norm; all of them would hash alike and be one task, so a salt deals them out.
    lacks = F.col("_t").isNull() | F.col("_n").isNull() | F.col("_y").isNull()
    left = left.withColumn("_s", F.when(lacks, F.xxhash64(own, "ref_tipo", *(["id"] if "id" in refs.columns else []))).otherwise(F.lit(0)))
    out = left.join(right.withColumn("_s", F.lit(0).cast("long")), ["_t", "_n", "_y", "_s"], "left").drop("_t", "_n", "_y", "_s")
    return out.withColumn("target_norm_id", F.when(F.col("ref_tipo") == "self_reference", F.col(own)).otherwise(F.col("_found"))).drop("_found")
