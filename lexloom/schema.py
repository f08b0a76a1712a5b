"""Fixed vocabulary of the data model and checks on it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status enumeration in pipeline order.
STATUSES = [
    "pending", "pdf_downloaded", "ocr_processing", "ocr_completed", "segmentation_processing", "segmented",
    "entity_extraction", "entities_extracted", "consolidation", "consolidated", "nlp_processing", "ready", "failed",
]
# Clause kinds that the segmenter emits.
KINDS = ["artigo", "paragrafo", "inciso", "alinea"]
# Alteration actions.
ACTIONS = ["REVOGA", "ALTERA", "ADICIONA", "SUBSTITUI", "REGULAMENTA", "REFERENCIA"]

NORM_SCHEMA = (
    "id long, tipo string, numero string, ano int, ementa string, status string, "
    "data_publicacao date, data_vigencia date, pdf_url string, pdf_path string"
)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of keys that break a uniqueness constraint, with how often each occurs."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def is_valid_status(c: Column) -> Column:
    return c.isin(STATUSES)


def clamp_page(page: int | None, size: int | None, most: int = 100) -> tuple[int, int]:
    """Page at least 1; page size from 1 to ``most``, 20 by default."""
    return max(1, int(page or 1)), min(most, max(1, int(size or 20)))


def clamp_k(k: int | None, most: int = 50) -> int:
    k = 10 if k is None else int(k)
    if k < 1:
        raise ValueError("k must be at least 1")
    return min(k, most)


def clamp_similarity(x: float | None) -> float:
    return max(0.0, min(1.0, float(x or 0.0)))


def year_range(first: int | None, last: int | None) -> tuple[int, int]:
    if first is None or last is None or first > last:
        raise ValueError("both years are needed, the first not after the last")
    return int(first), int(last)
