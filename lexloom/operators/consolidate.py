"""Consolidated text: revoked subtrees pruned, altered clauses marked, one text per norm."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.functions.text import clause_label, norm_label
from lexloom.operators.tree import paths


def counting(events: DataFrame) -> DataFrame:
    """Events that change a clause: only those whose target norm is the norm itself count; those that name no clause change none."""
    return events.filter(F.col("target_norm_id").isNotNull() & F.col("target_clause_id").isNotNull() & F.col("acao").isin("REVOGA", "ALTERA"))


def affected(events: DataFrame, by: str = "source_norm_id") -> DataFrame:
    """Per norm and target clause: revoked, and the source norm (or what ``by`` names) of its last alteration by (created_at, id)."""
    change = F.when(F.col("acao") == "ALTERA", F.struct("created_at", "id"))
    return counting(events).groupBy(F.col("target_norm_id").alias("norma_id"), "target_clause_id").agg(
        F.bool_or(F.col("acao") == "REVOGA").alias("revoked"), F.max_by(F.when(F.col("acao") == "ALTERA", F.col(by)), change).alias("altered_by"),
    )


def lines(clauses: DataFrame, events: DataFrame, norms: DataFrame, paths=paths) -> DataFrame:
    """Rows (norma_id, ordem, part, line): what the text shows of each clause that no revoked ancestor hides, in order.

    ``paths`` finds the ancestors: that of segmented trees, or ``tree.walk`` (with its ``keep``) for trees of any depth.
    Clauses that lie together by norm stay there: events get the label of their source where they lie and move once, to the
    norm they change, so that neither the join nor the paths move a text again.
    """
    source = norms.select(F.col("id").alias("source_norm_id"), norm_label(F.col("tipo"), F.col("numero"), F.col("ano")).alias("by"))
    e = counting(events).join(source, "source_norm_id", "left").select(
        F.col("target_norm_id").alias("norma_id"), F.col("target_clause_id").alias("id"), (F.col("acao") == "REVOGA").alias("revoked"),
        F.when(F.col("acao") == "ALTERA", F.struct("created_at", F.col("id").alias("event"))).alias("change"), "by",
    )
    c = clauses.select([c for c in ("norma_id", "id", "ordem", "tipo", "numero", "texto", "parent_ordem", "parent_id") if c in clauses.columns])
    both = c.withColumn("own", F.lit(True)).unionByName(e.repartition("norma_id"), allowMissingColumns=True)
    clause = W.partitionBy("norma_id", "id")
    hit = both.withColumns({"revoked": F.coalesce(F.bool_or("revoked").over(clause), F.lit(False)), "by": F.max_by("by", "change").over(clause)})
    x = paths(hit.filter("own").drop("own", "change"), "revoked").filter(~F.col("under"))
    pad = F.repeat(F.lit("  "), F.col("depth").cast("int"))
    label = clause_label(F.col("tipo"), F.col("numero"))
    first = F.when(F.col("revoked"), F.concat(pad, label, F.lit(" (REVOGADO)"))).otherwise(F.concat(pad, label, F.lit(" "), F.col("texto")))
    mark = F.when(~F.col("revoked") & F.col("by").isNotNull(), F.concat(pad, F.lit("  [ALTERADO pela "), F.col("by"), F.lit("]")))
    return x.select("norma_id", "ordem", F.posexplode(F.filter(F.array(first, mark), lambda v: v.isNotNull())).alias("part", "line"))


def statistics(clauses: DataFrame, events: DataFrame) -> DataFrame:
    """Per norm: clauses, distinct clauses that its events revoke and alter, events whose target norm it is."""
    named = F.col("target_clause_id").isNotNull()
    per = events.filter("target_norm_id is not null").groupBy(F.col("target_norm_id").alias("norma_id"), "target_clause_id").agg(
        F.max((named & (F.col("acao") == "REVOGA")).cast("int")).alias("r"), F.max((named & (F.col("acao") == "ALTERA")).cast("int")).alias("a"), F.count("*").alias("n"),
    )
    hits = per.groupBy("norma_id").agg(F.sum("r").alias("n_revoked"), F.sum("a").alias("n_altered"), F.sum("n").alias("n_events"))
    n = clauses.groupBy("norma_id").agg(F.count("*").alias("n_clauses"))
    return n.join(hits, "norma_id", "left").fillna(0, ["n_revoked", "n_altered", "n_events"])


def texts(norms: DataFrame, clauses: DataFrame, events: DataFrame, stamp: str = "", raw: DataFrame | None = None) -> DataFrame:
    """(norma_id, consolidated_text). ``stamp`` is the time shown, a parameter so that reruns agree.

    A norm without clauses keeps its raw text, where given.
    """
    body = lines(clauses, events, norms).groupBy("norma_id").agg(F.sort_array(F.collect_list(F.struct("ordem", "part", "line"))).alias("b"))
    body = body.select("norma_id", F.array_join(F.transform("b", lambda v: v["line"]), "\n").alias("body"))
    x = norms.withColumnRenamed("id", "norma_id").join(statistics(clauses, events), "norma_id", "left").join(body, "norma_id", "left")
    bar, dash = F.lit("=" * 80), F.lit("-" * 80)
    count = lambda text, c: F.concat(F.lit(f"  - {text}: "), F.col(c).cast("string"))
    day = lambda text, c: F.concat(F.lit(f"  - {text}: "), F.date_format(c, "yyyy-MM-dd"))
    head = [bar, F.concat(F.col("tipo"), F.lit(" Nº "), F.col("numero"), F.lit("/"), F.col("ano").cast("string")), F.lit("TEXTO CONSOLIDADO"), bar, F.lit("")]
    has_summary = F.coalesce("ementa", F.lit("")) != ""
    summary = [F.when(has_summary, F.concat(F.lit("EMENTA: "), F.col("ementa"))), F.when(has_summary, F.lit(""))]
    foot = [
        F.lit(""), dash, F.lit("INFORMAÇÕES DE CONSOLIDAÇÃO:"), count("Total de dispositivos", "n_clauses"), count("Dispositivos revogados", "n_revoked"),
        count("Dispositivos alterados", "n_altered"), count("Eventos processados", "n_events"), day("Data de publicação", "data_publicacao"),
        day("Data de vigência", "data_vigencia"), F.lit(f"  - Consolidado em: {stamp}") if stamp else F.lit(None).cast("string"), bar,
    ]
    full = F.array_join(F.filter(F.array(*head, *summary, F.col("body"), *foot), lambda v: v.isNotNull()), "\n")
    if raw is None:
        return x.filter("n_clauses > 0").select("norma_id", full.alias("consolidated_text"))
    x = x.join(raw, "norma_id", "left")
    return x.select("norma_id", F.when(F.col("n_clauses") > 0, full).otherwise(F.col("raw_text")).alias("consolidated_text"))
