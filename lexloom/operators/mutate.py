"""Changes of tables as pure functions: the old table and a delta give the new table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def upsert(old: DataFrame, new: DataFrame, key: str = "id", status: str | None = None) -> DataFrame:
    """New rows win; adds change: created, updated or kept. ``status``: what created and updated rows are set to."""
    o, n = old.withColumn("_o", F.lit(True)), new.withColumn("_n", F.lit(True))
    cols = [c for c in old.columns if c != key]
    x = o.alias("o").join(n.alias("n"), key, "full_outer")
    fresh = lambda c: F.lit(status) if c == "status" and status is not None else F.col(f"n.{c}")
    pick = [F.when(F.col("_n").isNotNull(), fresh(c)).otherwise(F.col(f"o.{c}")).alias(c) for c in cols]
    change = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNotNull(), "updated").otherwise("kept")
    return x.select(key, *pick, change.alias("change"))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first by arrival; a map-side combined min, so repeats do not travel."""
    rest = [c for c in rows.columns if c not in (key, order)]
    x = rows.groupBy(key).agg(F.min(order).alias(order), F.min_by(F.struct(*rest), order).alias("_r"))
    return x.select(key, order, "_r.*")


def new_only(rows: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def replace_children(old: DataFrame, new: DataFrame, key: str = "norma_id") -> DataFrame:
    """All rows of the keys in ``new`` give way to the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade(events: DataFrame, gone: DataFrame) -> DataFrame:
    """Events after the clauses ``gone`` (id): those that came from one go, those that point at one lose their target clause."""
    x = events.join(gone.select(F.col("id").alias("source_clause_id")), "source_clause_id", "left_anti")
    hit = gone.select(F.col("id").alias("_gone")).distinct()
    # Events without a target clause meet under their own number and match nothing: as nulls they would all be one task.
    target = F.col("target_clause_id")
    x = x.join(hit, (F.coalesce(target, F.col("source_clause_id")) == F.col("_gone")) & target.isNotNull(), "left")
    rest = [c for c in x.columns if c not in ("target_clause_id", "_gone")]
    return x.select(F.when(F.col("_gone").isNull(), target).alias("target_clause_id"), *rest)


def append_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append only: a rerun adds its events once more. ``replace_children`` on the source norm is the form that reruns agree with."""
    return old.unionByName(new)


def set_texts(norms: DataFrame, texts: DataFrame, status: str = "consolidated") -> DataFrame:
    """Norms with the consolidated texts (norma_id, consolidated_text) written back and their status set; others as they are."""
    x = norms.drop("consolidated_text").join(texts.select(F.col("norma_id").alias("id"), "consolidated_text"), "id", "left")
    return x.withColumn("status", F.when(F.col("consolidated_text").isNotNull(), status).otherwise(F.col("status")))


def set_vectors(clauses: DataFrame, vectors: DataFrame, model: str, now=None) -> DataFrame:
    """New vectors, the model they are from and, if ``now`` is given, when they came."""
    v = vectors.select("id", F.col("embedding").alias("_v"))
    x, new = clauses.join(v, "id", "left"), F.col("_v").isNotNull()
    if now is not None:
        x = x.withColumn("embedded_at", F.when(new, F.lit(now).cast("timestamp")))
    return x.withColumn("embedding_model", F.when(new, F.lit(model))).withColumn("embedding", F.coalesce("_v", "embedding")).drop("_v")


def clear_vectors(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn("embedding", F.lit(None).cast("array<float>"))


def norm_columns(payloads: DataFrame) -> DataFrame:
    """All columns that an upsert writes of each payload that is not rejected: those of ``ingest_projection`` with the text and
    the payload as they came, and the status with which work begins."""
    x = checked_payloads(payloads.select("arrival", "value"), F.col("value").alias("metadata")).filter("reason is null").drop("reason", "arrival")
    return x.withColumnRenamed("texto_integral", "original_text").withColumn("status", F.lit("pending"))


def ingest_projection(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of JSON payloads, as ``checked_payloads`` tells them apart."""
    x = checked_payloads(payloads)
    return x.filter("reason is null").drop("reason"), x.filter("reason is not null")


def checked_payloads(payloads: DataFrame, *own: Column) -> DataFrame:
    """JSON payloads as columns, with ``own`` columns of theirs and reason. The kind may be a string or an object with a
    description; fields that are not there are empty; malformed dates give null. A payload without id, or with a well-formed
    date that does not exist, is rejected and its reason says why. The full text field is the text and the address of the file."""
    fields = ["id", "tipo", "numero", "ano", "data", "data_vigencia", "ementa", "observacao", "texto_integral"]
    parsed = F.from_json("value", ", ".join(f"{c} string" for c in fields))
    # A generator, because conditions on the fields do not sink below it: as a projection each would parse the payload once more.
    kept = [c.alias(f"_own{i}") for i, c in enumerate(own)]
    x = payloads.select("arrival", *kept, F.inline(F.array(parsed)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))

    def date(c):
        well = text(c).rlike(r"^\d{4}-\d{2}-\d{2}$")
        return F.when(well, F.expr(f"try_to_date({c}, 'yyyy-MM-dd')")), well

    (published, p_ok), (in_force, v_ok) = date("data"), date("data_vigencia")
    ident = F.expr("nullif(try_cast(id as bigint), 0)")
    kind = F.when(F.startswith("tipo", F.lit("{")), F.get_json_object("tipo", "$.descricao")).otherwise(F.col("tipo"))
    why = F.when(ident.isNull(), "missing id").when((p_ok & published.isNull()) | (v_ok & in_force.isNull()), "impossible date")
    names = payloads.select(*own).columns if own else []
    return x.select(
        "arrival", ident.alias("id"), F.coalesce(kind, F.lit("")).alias("tipo"), text("numero").alias("numero"), F.expr("try_cast(ano as bigint)").alias("ano"),
        text("ementa").alias("ementa"), text("observacao").alias("observacao"), published.alias("published"), in_force.alias("in_force"), text("texto_integral").alias("texto_integral"),
        text("texto_integral").alias("pdf_url"), F.concat(F.lit("http://norms/"), F.col("id")).alias("page_url"), *[F.col(f"_own{i}").alias(c) for i, c in enumerate(names)], why.alias("reason"),
    )


def latest_status(log: DataFrame) -> DataFrame:
    key = F.struct("ts", "event_id")
    return log.groupBy("entity_id").agg(F.max_by("status", key).alias("status"), F.max("ts").alias("ts"), F.count("*").alias("n_changes"))


# Which status may follow which; any may fail.
NEXT = {
    "pending": ["pdf_downloaded", "ocr_completed"], "pdf_downloaded": ["ocr_processing"], "ocr_processing": ["ocr_completed"],
    "ocr_completed": ["segmentation_processing", "segmented"], "segmentation_processing": ["segmented", "ocr_completed"],
    "segmented": ["entity_extraction", "entities_extracted", "consolidated"], "entity_extraction": ["entities_extracted", "segmented"],
    "entities_extracted": ["consolidation", "consolidated"], "consolidation": ["consolidated"], "consolidated": [], "failed": ["pending"],
}
# A stage that finds nothing to work on goes back; the flag says whether a person has to look.
REVERTS = {"segmentation_processing": ("ocr_completed", True), "entity_extraction": ("segmented", False)}


def reverts(norms: DataFrame, found: DataFrame) -> DataFrame:
    """Sets norms in a stage that ``found`` (id, any number of rows) has nothing for back to the stage before; adds needs_review."""
    x = norms.drop("needs_review").join(found.groupBy("id").agg(F.count("*").alias("_n")), "id", "left")
    empty, status, review = F.col("_n").isNull(), F.col("status"), F.lit(False)
    for stage, (back, look) in REVERTS.items():
        here = empty & (F.col("status") == stage)
        status, review = F.when(here, back).otherwise(status), F.when(here, look).otherwise(review)
    return x.withColumn("needs_review", review).withColumn("status", status).drop("_n")


def transitions(log: DataFrame) -> DataFrame:
    """Status changes of each entity with whether the machine allows them."""
    w = W.partitionBy("entity_id").orderBy("ts", "event_id")
    x = log.withColumn("before", F.lag("status").over(w))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in NEXT.items() for b in bs])
    step = F.concat("before", F.lit(">"), "status")
    ok = F.col("before").isNull() | (F.col("status") == "failed") | F.array_contains(allowed, step)
    return x.withColumn("allowed", ok)


def ingestion_statistics(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n_rows"))


def ingestion_summary(rows: DataFrame, rejected: DataFrame, page_size: int = 50, shown: int = 10) -> DataFrame:
    """One row over all pages: pages, rows, failures, and the first errors by arrival (``shown`` of them, kept task by task)."""
    return checked_summary(rows.select("arrival", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("arrival", "reason")), page_size, shown)


def checked_summary(checked: DataFrame, page_size: int = 50, shown: int = 10) -> DataFrame:
    """``ingestion_summary`` of payloads with their reason, which are not told apart first."""
    failed = F.col("reason").isNotNull()
    total = checked.agg(F.ceil(F.count("*") / page_size).cast("long").alias("n_pages"), F.count_if(~failed).alias("n_rows"), F.count_if(failed).alias("n_failed"))
    head = checked.filter(failed).select("arrival", "reason").orderBy("arrival").limit(shown).agg(F.sort_array(F.collect_list(F.struct("arrival", "reason"))).alias("e"))
    text = F.array_join(F.transform("e", lambda v: F.concat(v["arrival"].cast("string"), F.lit(": "), v["reason"])), "; ")
    return total.withColumn("_one", F.lit(1)).join(head.select(text.alias("errors"), F.lit(1).alias("_one")), "_one").drop("_one")
