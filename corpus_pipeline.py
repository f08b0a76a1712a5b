"""A training corpus from ``documents``: toxic documents go, repeated line runs go, one of each group of
near copies stays, sources are mixed to target weights, and what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads back from Parquet.
In every stage, null and repeated ids are rows like others, columns beside those of ``documents`` are dropped,
and an empty table gives no rows.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import lines, mixing, packing, simhash, toxicity
from lexloom.llm.common import read, shared_folder
from lexloom.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half, from a model fitted on labelled rows of this input; null and empty
    texts stay, and without labels of both kinds every row does."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model, COLUMNS, spans=False).filter("score < 0.5").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go; so do documents of which nothing is left. Rows that agree in
    id and text are one document here and both stay; null texts stay null."""
    x = lines.deduplicate(docs.select(COLUMNS), min_words=50, keep_empty=False)
    return x.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies over five-word shingles stays: the smallest id, null ids last; rows that agree in
    all columns leave one. Null and empty texts are copies of each other."""
    return simhash.survivors(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target; a document stands as often as the mixture takes it. Null sources are one source; a source
    without words is not taken."""
    return mixing.draw(mixing.mix(docs.select(COLUMNS))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset; a null or empty text is one piece of its end id."""
    return packing.pack(packing.pieces(docs, tokenizer()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

# A trained model, a suffix array and hash permutations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = f"{root}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
