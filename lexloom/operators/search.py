"""Vector search and what a retrieval-augmented answer needs from it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.functions.text import clamp01, preview, repair_lists, strip
from lexloom.functions.vectors import cosine_distance, l2, literal, similarity
from lexloom.schema import clamp_k, clamp_similarity


def top_k(clauses: DataFrame, query, k: int = 10, norm_id: int | None = None, min_similarity: float = 0.0, metric: str = "l2", keep: list[str] | None = None) -> DataFrame:
    """The k nearest clauses: id, distance, score (ties by id) and ``keep`` columns; distance and score are rounded once all is decided.

    The filters run before the distance, and the sort keeps k rows a task, so the
    only shuffle moves k rows a task. An empty query gives no rows.
    """
    x = clauses.filter(has_vector(F.col("embedding")))
    if norm_id is not None:
        x = x.filter(F.col("norma_id") == norm_id)
    if query is None or not len(query):
        x, query = x.limit(0), [0.0]
    d = l2(F.col("embedding"), literal(query)) if metric == "l2" else cosine_distance(F.col("embedding"), literal(query))
    x = x.select("id", *(keep or []), d.alias("_d"))
    least = clamp_similarity(min_similarity)
    if least > 0:
        x = x.filter(F.col("_d") < 1.0 - least)
    x = x.orderBy("_d", "id").limit(clamp_k(k))
    return x.select("id", *(keep or []), F.round("_d", 6).alias("distance"), F.round(similarity(F.col("_d")), 6).alias("score"))


def has_vector(embedding) -> Column:
    """An empty array is no vector."""
    return F.coalesce(F.size(embedding) > 0, F.lit(False))


def top_k_of_queries(vectors: DataFrame, queries: DataFrame, k: int = 10, rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest vectors of every query (ties by vec_id; itself left out).

    Both sides are cut into blocks of about ``rows``; every block of queries meets every block of vectors in a task of
    its own, which returns k rows a query, so what is sorted at the end is k rows a query and block. Null and empty vectors, and
    those of another length than the query's, are no neighbours.
    """
    ok = has_vector(F.col("embedding"))
    v, q = vectors.filter(ok).select("vec_id", "embedding"), queries.filter(ok).select("vec_id", "embedding")
    cuts = lambda df: max(1, -(-df.count() // rows))
    n_v, n_q = cuts(v), cuts(q)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = v.select(F.lit(False).alias("asks"), block(n_v).alias("v"), every(n_q).alias("q"), "*").unionByName(q.select(F.lit(True).alias("asks"), every(n_v).alias("v"), block(n_q).alias("q"), "*"))

    def nearest(part):
        import numpy as np
        import pandas as pd

        out = []
        part["n"] = part["embedding"].map(len)
        for _, same in part.groupby("n"):
            x, y = same[~same["asks"]].sort_values("vec_id"), same[same["asks"]]
            if len(x) and len(y):
                ids, m = x["vec_id"].to_numpy(), np.stack(x["embedding"].to_numpy()).astype(float)
                for i, e in zip(y["vec_id"], y["embedding"]):
                    d = np.sqrt(((m - np.asarray(e, float)) ** 2).sum(1))
                    near = np.argsort(d, kind="stable")[: k + 1]
                    near = near[ids[near] != i][:k]
                    out.append(pd.DataFrame({"query_id": i, "vec_id": ids[near], "_d": d[near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "_d": []})

    found = both.groupBy("q", "v").applyInPandas(nearest, "query_id long, vec_id long, _d double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("_d", "vec_id")).cast("long")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("_d", 6).alias("distance"))


def confidence(hits: DataFrame) -> DataFrame:
    return hits.agg(F.coalesce(F.round(F.avg("score"), 6), F.lit(0.0)).alias("confidence"), F.count("*").alias("n_hits"))


def context_parts(hits: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """Parts in rank order while their lengths, without rank prefix and separators, fit four characters a token.

    Expects norm_label, path, texto, score, distance of the k hits, so the window sees k rows.
    """
    part = F.concat(F.lit("["), F.format_string("%.2f", "score"), F.lit("] "), F.col("norm_label"), F.lit(" | "), F.col("path"), F.lit(": "), F.col("texto"))
    w = W.partitionBy(F.lit(1)).orderBy("distance", "id")
    x = hits.withColumn("part", part).withColumn("rank", F.row_number().over(w).cast("long"))
    x = x.withColumn("used", F.sum(F.length("part")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    return x.filter(F.col("used") <= 4 * max_tokens).withColumn("shown", F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("part")))


# What an empty search says.
NO_CONTEXT = "Nenhum contexto relevante encontrado."
NO_ANSWER = "Não encontrei informações relevantes para responder esta pergunta."
FAILED_ANSWER = "Erro ao gerar resposta. Por favor, tente novamente."


def context(parts: DataFrame) -> DataFrame:
    """One row: the parts joined by an empty line, and how many; without any, a fixed sentence."""
    got = parts.agg(F.sort_array(F.collect_list(F.struct("rank", "shown"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda v: v["shown"]), "\n\n")
    return got.select(F.when(F.size("p") > 0, joined).otherwise(NO_CONTEXT).alias("context"), F.size("p").cast("long").alias("n_parts"))


def hit_cards(hits: DataFrame) -> DataFrame:
    """Search results, nearest first: the clause with its norm as one column, its place and its parent; expects parent_label."""
    return hits.orderBy("distance", "id").select("id", "norm", "path", "parent_label", "texto", "score")


def source_cards(hits: DataFrame) -> DataFrame:
    """Sources of an answer, nearest first."""
    return hits.orderBy("distance", "id").select("id", "norm_label", "path", preview(F.col("texto"), 200).alias("text_preview"), F.col("texto").alias("full_text"), clamp01(F.col("score")).alias("score"))


PROMPT = """Responda em português claro e objetivo à pergunta, usando apenas os dispositivos legais abaixo.
Formate em Markdown, cite os dispositivos em **negrito**, um item de lista por linha, e diga quando faltar informação.

CONTEXTO LEGAL:
%s

PERGUNTA DO USUÁRIO:
%s

RESPOSTA:"""


def prompts(contexts: DataFrame, question: str) -> DataFrame:
    return contexts.withColumn("prompt", F.format_string(PROMPT, "context", F.lit(question)))


def answers(prompted: DataFrame, generate, hits: DataFrame | None = None) -> DataFrame:
    """``generate`` maps a prompt Column to an answer Column (a provider's vectorised UDF, or a stub; null: it failed).

    With ``hits``, adds confidence, the mean score of all hits; 0 where there is none or no answer came, which fixed sentences say.
    """
    said = strip(repair_lists(generate(F.col("prompt"))))
    if hits is None:
        return prompted.withColumn("answer", said)
    one = F.broadcast(confidence(hits).withColumn("_one", F.lit(1)))  # one row
    x = prompted.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one").withColumn("_said", said)
    found = F.col("n_hits") > 0
    x = x.withColumn("answer", F.when(~found, NO_ANSWER).otherwise(F.coalesce(F.nullif("_said", F.lit("")), F.lit(FAILED_ANSWER))))
    return x.withColumn("confidence", F.when(found & (F.coalesce("_said", F.lit("")) != ""), F.col("confidence")).otherwise(0.0)).drop("_said")


def stub_answer(prompt):
    """Stands in for a language model: says how long the prompt was."""
    return F.concat(F.lit("Resumo: • itens; • tamanho "), F.length(prompt).cast("string"))


def stub_embedding(text, dim: int = 64):
    """Deterministic unit vector from hashes of the text, for use without a model server."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.pmod(F.xxhash64(text, i), F.lit(2001)) - 1000) / 1000.0)
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / size)


def cached_embeddings(texts: DataFrame, cache: DataFrame, model: str, embed=stub_embedding, now=None) -> DataFrame:
    """Adds embedding and cache_hit: from the cache where its key is there and, if ``now`` is given, not expired by then
    (``cache`` then holds stored_at); else computed. An empty or null text has no vector."""
    from lexloom.functions.text import cache_key

    if now is not None:
        cache = unexpired(cache, now, TTL["embedding"])
    x = texts.withColumn("cache_key", cache_key("embedding:", F.concat(F.lit(f"{model}:"), F.col("text"))))
    x = x.join(cache.select("cache_key", F.col("embedding").alias("_c")), "cache_key", "left")
    fresh = F.when(F.coalesce("text", F.lit("")) != "", embed(F.col("text")))
    return x.withColumn("cache_hit", F.col("_c").isNotNull()).withColumn("embedding", F.coalesce("_c", fresh)).drop("_c")


# How long cached entries live, in seconds.
TTL = {"embedding": 7 * 24 * 3600, "search": 24 * 3600, "answer": 12 * 3600}


def cache_metrics(looked_up: DataFrame) -> DataFrame:
    """Rows, hits and hit rate in percent of a look-up that says cache_hit."""
    n, k = F.count("*"), F.count_if("cache_hit")
    return looked_up.agg(n.alias("n_rows"), k.alias("n_hits"), F.coalesce(F.round(100.0 * k / F.nullif(n, F.lit(0)), 1), F.lit(0.0)).alias("hit_rate"))


def unexpired(cache: DataFrame, now, ttl_seconds: int) -> DataFrame:
    return cache.filter(F.unix_timestamp("stored_at") + ttl_seconds > F.unix_timestamp(F.lit(now).cast("timestamp")))


def assign_cells(vectors: DataFrame, centroids: list) -> DataFrame:
    """Inverted-file layout: adds cell, the nearest of a few centroids; write it partitioned by cell."""
    d = F.array(*[F.struct(l2(F.col("embedding"), literal(c)).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(centroids)])
    return vectors.withColumn("cell", F.array_min(d)["cell"])


def train_cells(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 10, seed: int = 3) -> list:
    """Centroids by k-means over about ``sample`` vectors, chosen by hash: the bound on what reaches the driver."""
    import numpy as np

    x = vectors.filter(has_vector(F.col("embedding")))
    share = min(1.0, sample / max(1, x.count())) * (1 << 30)
    got = x.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < share).orderBy("vec_id").select("embedding").limit(2 * sample).collect()
    if not got:
        return []
    m = np.array([r.embedding for r in got], float)
    c = m[np.random.default_rng(seed).choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        at = ((m * m).sum(1)[:, None] - 2 * m @ c.T + (c * c).sum(1)).argmin(1)
        c = np.stack([m[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
    return c.tolist()


def nearest_cells(centroids: list, query, n_probe: int) -> list[int]:
    order = sorted(range(len(centroids)), key=lambda i: sum((a - b) ** 2 for a, b in zip(centroids[i], query)))
    return order[:n_probe]


def probe(vectors: DataFrame, centroids: list, query, n_probe: int) -> DataFrame:
    """Rows of the cells nearest to the query; a partition filter when the table is laid out by cell."""
    return vectors.filter(F.col("cell").isin(nearest_cells(centroids, query, n_probe)))


def probe_queries(vectors: DataFrame, queries: DataFrame, centroids: list, n_probe: int, k: int = 10, salts: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, distance) as ``top_k_of_queries``, from the ``n_probe`` cells nearest to each query only.

    Each query goes to its cells; cells are split by salt, so that none is one group; each part returns k rows a query.
    """
    ok = has_vector(F.col("embedding"))
    near = F.array_sort(F.array(*[F.struct(l2(F.col("embedding"), literal(c)).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(centroids)]))
    q = queries.filter(ok).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"), F.explode(F.transform(F.slice(near, 1, n_probe), lambda x: x["cell"])).alias("cell"))
    q = q.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    v = assign_cells(vectors.filter(ok), centroids).withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")).select("cell", "_s", "vec_id", "embedding")
    pairs = v.join(q, ["cell", "_s"]).filter(F.col("vec_id") != F.col("query_id")).select("query_id", "_s", "vec_id", l2(F.col("embedding"), F.col("_q").cast("array<double>")).alias("_d"))
    top = lambda x, by: x.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("_d", "vec_id")).cast("long")).filter(F.col("rank") <= k)
    return top(top(pairs, ["query_id", "_s"]).drop("rank"), ["query_id"]).select("query_id", "rank", "vec_id", F.round("_d", 6).alias("distance"))
