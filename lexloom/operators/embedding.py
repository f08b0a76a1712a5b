"""Vectors for rows that lack one, as one job: distinct texts, cache, model, write-back.

Equal texts are asked for once; texts that the cache still answers are not asked for at all;
the rest goes to a provider in batches inside the tasks. What the provider returned is
written down before anything reads it, so no text is asked for twice, and goes back both to
the rows and to the cache. A text that failed leaves its rows as they were, for the next run.
"""

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import cache_key, strip
from lexloom.operators.search import TTL, has_vector, unexpired


@dataclass
class HttpProvider:
    """Vectors from a model server, a request a text: {"model", "prompt"} gives {"embedding"}. No answer in ``timeout``
    seconds, or an answer without a vector, is a failure of that text."""

    url: str
    model: str
    timeout: float = 30.0
    opener: object = urllib.request.urlopen

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> list[float] | None:
        body = json.dumps({"model": self.model, "prompt": text}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        with self.opener(request, timeout=self.timeout) as answer:
            return json.loads(answer.read()).get("embedding") or None


def ask(provider, texts: list[str], tries: int, wait: float) -> list[list[float] | None]:
    """A batch of vectors, null where none came. A batch that fails is tried again after growing pauses, then text by text."""
    for n in range(tries):
        try:
            got = provider(texts)
            if len(got) != len(texts):
                raise ValueError("not a vector a text")
            return [list(map(float, v)) if v is not None and len(v) else None for v in got]
        except (OSError, ValueError):  # time-outs and refused connections are OSError
            if n + 1 < tries:
                time.sleep(wait * 2**n)
    return [ask(provider, [t], 1, wait)[0] for t in texts] if len(texts) > 1 else [None]


def computed(texts: DataFrame, provider, batch: int = 32, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(cache_key, embedding) of rows (cache_key, text), the provider called in batches of so many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({"cache_key": part["cache_key"].to_numpy(), "embedding": ask(provider, part["text"].tolist(), tries, wait)})

    return texts.select("cache_key", "text").mapInPandas(run, "cache_key string, embedding array<double>")


def embed(rows: DataFrame, cache: DataFrame, provider, model: str, now, keep, force: bool = False, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, cache, report): rows (id, text, embedding, any more) with vectors, the cache (cache_key, embedding, stored_at) with
    new entries, and one row of counts: rows that asked, rows without text, distinct texts, found in the cache, computed, failed.

    Without ``force`` only rows without a vector ask. Entries beyond their life by ``now`` are computed anew. ``keep`` writes a
    table down. Rows get embedding_model and embedded_at where their vector is new.
    """
    ask_for = F.lit(True) if force else ~has_vector(F.col("embedding"))
    has_text = F.coalesce(strip(F.col("text")) != "", F.lit(False))
    x = rows.withColumn("_key", F.when(ask_for & has_text, cache_key("embedding:", F.concat(F.lit(f"{model}:"), F.col("text")))))
    texts = x.filter("_key is not null").groupBy(F.col("_key").alias("cache_key")).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    live = unexpired(cache, now, TTL["embedding"]).select("cache_key", F.col("embedding").alias("_hit"))
    looked = keep(texts.join(live, "cache_key", "left"))
    fresh = keep(computed(looked.filter("_hit is null"), provider, **how))
    found = looked.select("cache_key", "n", "_hit").join(fresh.withColumnRenamed("embedding", "_new"), "cache_key", "left")
    vectors = found.select(F.col("cache_key").alias("_key"), F.coalesce("_hit", "_new").alias("_v"))
    kind = rows.schema["embedding"].dataType
    new = F.col("_v").isNotNull()
    out = x.join(vectors, "_key", "left").withColumns({
        "embedding": F.coalesce(F.col("_v").cast(kind), "embedding"),
        "embedding_model": F.when(new, model).otherwise(F.col("embedding_model") if "embedding_model" in rows.columns else F.lit(None).cast("string")),
        "embedded_at": F.when(new, F.lit(now).cast("timestamp")).otherwise(F.col("embedded_at") if "embedded_at" in rows.columns else F.lit(None).cast("timestamp")),
    })
    stored = fresh.filter("embedding is not null").select("cache_key", F.col("embedding").cast(cache.schema["embedding"].dataType).alias("embedding"), F.lit(now).cast("timestamp").alias("stored_at"))
    kept = cache.select("cache_key", "embedding", "stored_at").join(stored.select("cache_key"), "cache_key", "left_anti").unionByName(stored)
    asked = rows.agg(F.count_if(ask_for).alias("n_rows"), F.count_if(ask_for & ~has_text).alias("n_empty"), F.lit(1).alias("_one"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    counts = found.agg(
        F.count("*").alias("n_texts"), F.count("_hit").alias("n_cached"), F.count_if(F.col("_hit").isNull() & F.col("_new").isNotNull()).alias("n_computed"),
        zero(F.count_if(F.col("_hit").isNull() & F.col("_new").isNull())).alias("n_failed"), F.lit(1).alias("_one"),
    )
    return out.drop("_key", "_v"), kept, asked.join(counts, "_one").drop("_one")
