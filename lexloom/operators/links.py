"""Joins between clauses, norms and events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import action_name, clause_label, norm_label


def with_parent(clauses: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Adds parent_label; parents are looked up ``among`` other clauses where some are left out of the first."""
    p = (clauses if among is None else among).select(F.col("id").alias("parent_id"), clause_label(F.col("tipo"), F.col("numero")).alias("parent_label"))
    return clauses.join(p, "parent_id", "left")


def with_norm(clauses: DataFrame, norms: DataFrame) -> DataFrame:
    """Adds norm_label and norm (id, tipo, numero, ano)."""
    own = F.struct("id", "tipo", "numero", F.col("ano").cast("long").alias("ano"))
    n = norms.select(F.col("id").alias("norma_id"), norm_label(F.col("tipo"), F.col("numero"), F.col("ano")).alias("norm_label"), own.alias("norm"))
    return clauses.join(n, "norma_id")


def sourced(events: DataFrame, *more: str) -> DataFrame:
    """Events made of the clauses themselves with source_label (and ``more`` of the clause, as source_...), which saves the join
    with their source clauses; ``events`` are those rows, with the clause's tipo and numero."""
    return events.withColumn("source_label", clause_label(F.col("tipo"), F.col("numero"))).withColumnsRenamed({c: f"source_{c}" for c in more}).drop("tipo", "numero")


def at_target(events: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Left join on a target's key. Events without one meet under their own number and match nothing: as nulls they would all
    be one task."""
    own = F.col(key)
    x = rows.withColumnRenamed(key, "_at")
    return events.join(x, (F.coalesce(own, -F.col("id")) == F.col("_at")) & own.isNotNull(), "left").drop("_at")


def event_chain(events: DataFrame, clauses: DataFrame, norms: DataFrame) -> DataFrame:
    """Event with source clause, source norm and, where there are, target clause and target norm; ``sourced`` events are
    not joined with their source clauses."""
    name = clause_label(F.col("tipo"), F.col("numero"))
    src = clauses.select(F.col("id").alias("source_clause_id"), name.alias("source_label"))
    tgt = clauses.select(F.col("id").alias("target_clause_id"), name.alias("target_label"), F.col("norma_id").alias("target_owner"))
    n = norms.select(F.col("id").alias("source_norm_id"), norm_label(F.col("tipo"), F.col("numero"), F.col("ano")).alias("source_norm"))
    to = n.withColumnsRenamed({"source_norm_id": "target_norm_id", "source_norm": "target_norm"})
    # The source norm first: events that come norm by norm stay where they are.
    x = events.join(n, "source_norm_id")
    x = x if "source_label" in events.columns else x.join(src, "source_clause_id")
    return at_target(at_target(x, tgt, "target_clause_id"), to, "target_norm_id")


def touching(chain: DataFrame, norm_id: int) -> DataFrame:
    """Events whose target or source belongs to the norm."""
    return chain.filter((F.col("target_norm_id") == norm_id) | (F.col("source_norm_id") == norm_id))


def internal(events: DataFrame) -> DataFrame:
    return events.filter(F.col("source_norm_id") == F.col("target_norm_id"))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by primary key; callers order by (created_at, id)."""
    return a.unionByName(b).dropDuplicates(["id"])


def embedding_input(clauses: DataFrame) -> DataFrame:
    """``norm | path | [Contexto: parent |] text``; expects norm_label, path, parent_label."""
    context = F.concat(F.lit("Contexto: "), F.col("parent_label"))
    return clauses.withColumn("embedding_input", F.concat_ws(" | ", "norm_label", "path", context, "texto"))


def event_labels(events: DataFrame, located: DataFrame, norms: DataFrame) -> DataFrame:
    """(id, label, description) of events; ``located`` are clauses with their paths, which ``sourced`` events have themselves.

    The target is a clause, else a norm, else the quoted text; one that is not there counts as not identified.
    """
    n = norms.select(F.col("id").alias("_n"), norm_label(F.col("tipo"), F.col("numero"), F.col("ano")).alias("_norm"))

    def clauses(end: str) -> DataFrame:
        c = located.select(F.col("id").alias(f"{end}_clause_id"), F.col("norma_id").alias("_n"), clause_label(F.col("tipo"), F.col("numero")).alias(f"{end}_label"), F.col("path").alias(f"{end}_path"))
        return c.join(n, "_n").withColumnsRenamed({"_n": f"{end}_owner", "_norm": f"{end}_norm"})

    if "source_path" in events.columns:
        x = events.join(n.withColumnRenamed("_norm", "source_norm"), F.col("source_norm_id") == F.col("_n")).withColumnRenamed("_n", "source_owner")
    else:
        x = events.join(clauses("source"), "source_clause_id")
    named = n.select(F.col("_n").alias("target_norm_id"), F.col("_norm").alias("named"))
    # The quoted text travels on only where it is what the label says.
    x = at_target(x, named, "target_norm_id").withColumn("target_text", F.when(F.col("named").isNull(), F.col("target_text")))
    x = at_target(x, clauses("target"), "target_clause_id")
    acao, at_clause, at_norm = action_name(F.col("acao")), F.col("target_label").isNotNull(), F.col("named").isNotNull()
    label = F.concat("source_label", F.lit(" "), acao, F.lit(" "), F.coalesce("target_label", "named", F.lit("(não identificado)")))
    elsewhere = F.when(F.col("target_owner") != F.col("source_owner"), F.concat(F.lit(" da "), F.col("target_norm"))).otherwise("")
    what = F.when(at_clause, F.concat(F.lit(" o "), F.col("target_path"), elsewhere)).when(at_norm, F.concat(F.lit(" dispositivo(s) da "), F.col("named")))
    what = what.otherwise(F.concat(F.lit(" '"), F.col("target_text"), F.lit("'")))
    return x.select("id", label.alias("label"), F.concat(F.lit("Na "), F.col("source_norm"), F.lit(", o "), F.col("source_path"), F.lit(" "), acao, what).alias("description"))
