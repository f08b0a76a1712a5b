"""Views that show the star-schema tables as the legislative data model.

Each view is a projection plus at most one window, so filters and column pruning
still reach the parquet scans.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.sources.tables import table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def norms(spark: SparkSession, d: str) -> DataFrame:
    pub = F.col("o_orderdate").cast("date")
    p = F.substring("o_orderpriority", 1, 1)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(p == "1", "Lei").when(p == "2", "Lei Complementar").when(p == "3", "Decreto").when(p == "4", "Resolução").otherwise("Portaria").alias("tipo"),
        F.col("o_orderkey").cast("string").alias("numero"),
        F.year("o_orderdate").alias("ano"),
        F.concat(F.lit("Dispõe sobre o pedido "), F.col("o_orderpriority"), F.lit(" do cliente "), F.col("o_custkey").cast("string")).alias("ementa"),
        F.when(F.col("o_orderstatus") == "F", "consolidated").when(F.col("o_orderstatus") == "O", "segmented").otherwise("entities_extracted").alias("status"),
        pub.alias("data_publicacao"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_add(pub, 45)).alias("data_vigencia"),
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("http://norms/"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))).alias("pdf_url"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("/pdf/"), F.col("o_orderkey").cast("string"))).alias("pdf_path"),
    )


def clauses(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    x = table(spark, d, "lineitem").withColumn("ordem", (F.row_number().over(w) - 1).cast("long"))
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("ordem") % 10 + 1).cast("int"))
    s = lambda c: F.col(c).cast("string")
    kind = F.when((F.col("ordem") == 0) | (F.col("l_partkey") % 4 == 0), "artigo").when(F.col("l_partkey") % 4 == 1, "paragrafo").when(F.col("l_partkey") % 4 == 2, "inciso").otherwise("alinea")
    x = x.withColumn("tipo", kind)
    numero = (
        F.when(F.col("tipo") == "artigo", F.concat((F.col("ordem") + 1).cast("string"), F.lit("º")))
        .when(F.col("tipo") == "paragrafo", F.concat(s("l_linenumber"), F.lit("º")))
        .when(F.col("tipo") == "inciso", pick("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"))
        .otherwise(pick(*"abcdefghij"))
    )
    texto = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Fica revogado o art. "), (F.col("l_suppkey") % 20 + 1).cast("string"), F.lit("º da Lei nº "), s("l_partkey"), F.lit("/"), F.year("l_shipdate").cast("string"), F.lit(".")))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("Modifica o inciso II da Lei Complementar n. "), s("l_suppkey"), F.lit(", conforme o Decreto "), s("l_partkey"), F.lit("/"), F.year("l_shipdate").cast("string"), F.lit(" e altera o disposto.")))
        .when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("Aplica-se o disposto desta Lei ao item "), s("l_partkey"), F.lit(" do cadastro.")))
        .otherwise(F.concat(F.lit("Cadastro "), s("l_partkey"), F.lit(" sem efeito.")))
    )
    return x.select(
        (F.col("l_orderkey") * 100 + F.col("ordem")).alias("id"), F.col("l_orderkey").alias("norma_id"), "tipo", numero.alias("numero"),
        texto.alias("texto"), "ordem", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_shipdate").alias("created_at"),
    )


def with_parents(c: DataFrame) -> DataFrame:
    from lexloom.operators.segment import parent_index

    parent = parent_index(F.col("tipo"), F.col("ordem"), W.partitionBy("norma_id").orderBy("ordem"))
    return c.withColumn("parent_ordem", parent).withColumn("parent_id", F.col("norma_id") * 100 + F.col("parent_ordem"))


def with_vectors(spark: SparkSession, d: str, c: DataFrame) -> DataFrame:
    """Clauses with the vectors of the whole table, dealt by id; every seventh clause has none."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = v.count()
    joined = c.withColumn("vec_id", F.col("id") % n if n else F.lit(None).cast("long")).join(v, "vec_id", "left")
    return joined.withColumn("embedding", F.when(F.col("id") % 7 != 0, F.col("embedding"))).drop("vec_id")


def alteration_events(c: DataFrame, *own: str) -> DataFrame:
    """An event a clause; ``own`` columns of the clause stay with it."""
    return c.select(
        "id", F.col("id").alias("source_clause_id"), F.col("norma_id").alias("source_norm_id"),
        F.when(F.col("l_returnflag") == "R", "REVOGA").when(F.col("l_returnflag") == "A", "ALTERA").otherwise("REFERENCIA").alias("acao"),
        F.when(F.col("l_partkey") % 5 == 0, F.col("norma_id")).when(F.col("l_partkey") % 5 < 4, F.col("l_partkey")).alias("target_norm_id"),
        F.when((F.col("ordem") > 0) & (F.col("l_partkey") % 3 == 0), F.col("id") - 1).alias("target_clause_id"),
        F.substring("texto", 1, 500).alias("target_text"), "created_at", *own,
    )


def shared_events(c: DataFrame) -> DataFrame:
    """``alteration_events``, those of clauses without a norm apart: where only clauses with a norm are asked for beside them, both
    read the same rows of the table, so that Spark shuffles these once."""
    return alteration_events(c.filter("norma_id is not null")).unionByName(alteration_events(c.filter("norma_id is null")))


def raw_texts(c: DataFrame) -> DataFrame:
    marker = (
        F.when(F.col("tipo") == "artigo", F.concat(F.lit("Art. "), F.col("numero"), F.lit(" ")))
        .when(F.col("tipo") == "paragrafo", F.concat(F.lit("§ "), F.col("numero"), F.lit(" ")))
        .when(F.col("tipo") == "inciso", F.concat(F.col("numero"), F.lit(" - ")))
        .otherwise(F.concat(F.col("numero"), F.lit(") ")))
    )
    lines = F.sort_array(F.collect_list(F.struct("ordem", F.concat(marker, F.col("texto")).alias("line"))))
    return c.groupBy("norma_id").agg(lines.alias("x")).select("norma_id", F.array_join(F.transform("x", lambda y: y["line"]), "\n").alias("raw_text"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content"))


def cited(m: DataFrame) -> DataFrame:
    """Messages whose first three words stand for the sources they cite."""
    return m.withColumn("sources", F.slice(F.split("content", " ", -1), 1, 3))


def sessions(m: DataFrame) -> DataFrame:
    """One session per conversation; seven users; the last turn stands for its time."""
    return m.groupBy("session_id").agg(F.max("turn").alias("updated_at")).withColumn("user_id", F.col("session_id") % 7).withColumn(
        "title", F.when(F.col("session_id") % 2 == 0, F.concat(F.lit("Sessão "), F.col("session_id").cast("string"))).otherwise(F.lit(""))
    )


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """JSON of the REST shape; the kind is nested in two rows of three, one row in eleven has no id, some dates are malformed
    and some are well formed but do not exist."""
    n = norms(spark, d)
    when = F.when(F.col("id") % 10 == 9, F.lit("not a date")).when(F.col("id") % 10 == 8, F.lit("2001-02-30")).otherwise(F.date_format("data_publicacao", "yyyy-MM-dd"))
    kind = F.when(F.col("id") % 3 == 0, F.to_json(F.struct("tipo"))).otherwise(F.to_json(F.struct(F.struct(F.col("tipo").alias("descricao")).alias("tipo"))))
    rest = F.to_json(F.struct(
        F.when(F.col("id") % 11 != 0, F.col("id")).alias("id"), "numero", "ano", when.alias("data"), F.date_format("data_vigencia", "yyyy-MM-dd").alias("data_vigencia"),
        "ementa", F.when(F.col("id") % 4 == 0, F.lit("sem observação")).alias("observacao"), F.col("pdf_url").alias("texto_integral"),
    ))
    both = F.concat(F.substring(kind, F.lit(1), F.length(kind) - 1), F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    return n.select(F.col("id").alias("arrival"), both.alias("value"))


def status_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "view", "ocr_completed").when(kind == "click", "segmented").when(kind == "purchase", "consolidated").otherwise("failed")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("entity_id"), status.alias("status"), "ts")
