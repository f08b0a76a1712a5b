"""One registered query for each operator, over its whole table; SQL where it can state the result."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import keep, n_words, numbered, read, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_best_fit_packing(spark, d):
    from lexloom.llm import packing

    cut = packing.pieces(read(spark, d, "documents"), tokenizer())
    return packing.pack(cut)


@query
def op4_source_mixing(spark, d):
    from lexloom.llm import mixing

    docs = read(spark, d, "documents").select("doc_id", "source", n_words(text_of("text")).alias("words"))
    x = numbered(mixing.mix(keep(docs), F.col("words")), "row")
    # Words taken are those of the copies that the shards draw.
    drawn = mixing.draw(x).groupBy("row").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("copy.shard")).alias("shards"))
    x = x.join(drawn, "row", "left").withColumn("taken", F.col("size") * F.coalesce("n", F.lit(0)))
    return x.select("doc_id", "size", "source_size", "target", "taken", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


@query
def op7_sampled_range_sharding(spark, d):
    from lexloom.llm import sharding

    x = sharding.shard(read(spark, d, "documents"), 8)
    return x.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_simhash_vantage_trees(spark, d):
    from lexloom.llm import simhash

    x = simhash.groups(read(spark, d, "documents"))
    return x.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_sorted_projections(spark, d):
    from lexloom.llm import vectors

    return vectors.near_duplicates(read(spark, d, "embeddings"))


@query
def op2_chat_schema_fingerprints(spark, d):
    from lexloom.llm import chat

    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    x = chat.conversations(rows).withColumn("back", chat.read_back()).withColumn("loss", chat.loss_text())
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op10_scaled_sketch(spark, d):
    from lexloom.llm import sketch

    return sketch.compared(read(spark, d, "documents"))


@query
def op3_suffix_array_lines(spark, d):
    from lexloom.llm import lines

    return lines.deduplicate(read(spark, d, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query
def op5_crf_toxicity(spark, d):
    from lexloom.llm import toxicity

    docs = read(spark, d, "documents")
    model = toxicity.fit(docs, read(spark, d, "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    x = toxicity.score(docs, model, ["doc_id"])
    return x.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "spans")


@query
def op9_site_style_trees(spark, d):
    from lexloom.llm import html

    return html.extract(read(spark, d, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op11_orchard_codes(spark, d):
    from lexloom.llm import codes

    return codes.compressed(read(spark, d, "embeddings"))


@query
def op12_rank_queue_bpe(spark, d):
    import public_tokenizers

    from lexloom.llm import tokens

    own = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    x = tokens.decode(tokens.encode(read(spark, d, "documents"), *own, ["doc_id"]), *own)
    written = F.array_join(F.col("ids").cast("array<string>"), ",")
    return x.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_turn_repair(spark, d):
    from lexloom.llm import repair

    x = repair.repair(repair.damaged(read(spark, d, "conversations")))
    return x.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


# Conversations as the template of the chat module writes them: a turn is <|turn|>role, line break, text, <|end|>, line break,
# with a backslash as \e and <| as <\p.
_SAID = "'\\### Assistant: </turn> ok'"
_ORDER = "ORDER BY turn NULLS FIRST, role, text"
_ESCAPED = "replace(replace({0}, '\\', '\\e'), '<|', '<\\p')"
ORACLE["op2_chat_schema_fingerprints"] = f"""WITH r AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', {_SAID}), (-7, 1, 'assistant', {_SAID})))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length('<|turn|>') + length(replace({_ESCAPED.format('role')}, chr(10), '\\n')) + 1 + length({_ESCAPED.format('text')}) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""

# Runs of 50 words or more: the shortest from each line on and up to each line; a run that an earlier (doc_id, line) shows, goes.
ORACLE["op3_suffix_array_lines"] = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents),
k AS (SELECT doc_id, ln, line, trim(line, ' ') AS key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY ln) AS c1 FROM k),
often AS (SELECT key FROM c GROUP BY 1 HAVING count(*) > 1), m AS (SELECT * FROM c WHERE key IN (SELECT key FROM often)),
runs AS (SELECT b.doc_id, b.ln AS b, min(e.ln) AS e FROM m b JOIN c e ON e.doc_id = b.doc_id AND e.ln >= b.ln AND e.c1 - b.c1 + b.w >= 50 GROUP BY 1, 2
 UNION SELECT e.doc_id, max(b.ln), e.ln FROM m e JOIN c b ON e.doc_id = b.doc_id AND e.ln >= b.ln AND e.c1 - b.c1 + b.w >= 50 GROUP BY 1, 3),
said AS (SELECT r.doc_id, r.b, r.e, list(c.key ORDER BY c.ln) AS lines FROM runs r JOIN c ON c.doc_id = r.doc_id AND c.ln BETWEEN r.b AND r.e GROUP BY 1, 2, 3),
ranked AS (SELECT doc_id, b, e, min((doc_id, b)) OVER (PARTITION BY lines) AS first_ FROM said),
gone AS (SELECT DISTINCT doc_id, unnest(range(b, e + 1)) AS ln FROM ranked WHERE (doc_id, b) > first_),
kept AS (SELECT c.doc_id, count(*) AS n_lines, count(g.ln) AS n_removed, string_agg(line, chr(10) ORDER BY c.ln) FILTER (g.ln IS NULL) AS t FROM c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.ln = c.ln GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""
# Every pair of vectors, and what links reach.
ORACLE["op8_sorted_projections"] = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n_links FROM link GROUP BY 1)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds as common tables: p has the parts of vectors, b<k> the codebooks after k rounds, a<k> who is nearest to them."""
    floor = "(sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*)"
    near = "min(list_sum(list_transform(range(len(x)), lambda i: (x[i + 1] - c[i + 1]) * (x[i + 1] - c[i + 1])))::HUGEINT * 256 + e)"
    t = [
        "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS q"
        " FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT rid, k AS part, q[k * (len(q) // {parts}) + 1 : (k + 1) * (len(q) // {parts})] AS x FROM v, range({parts}) AS t(k))",
        f"b0 AS MATERIALIZED (SELECT part, rid AS e, x AS c FROM p WHERE rid < {entries})",
    ]
    for k in range(rounds + 1):
        t.append(f"a{k} AS MATERIALIZED (SELECT rid, part, any_value(x) AS x, {near} AS m FROM p JOIN b{k} USING (part) GROUP BY rid, part)")
        if k < rounds:
            t.append(f"m{k} AS (SELECT part, m % 256 AS e, i, {floor} AS w FROM (SELECT part, m, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k}) GROUP BY 1, 2, 3)")
            t.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT part, e, list(w ORDER BY i) AS c FROM m{k} GROUP BY 1, 2) n ON n.part = b.part AND n.e = b.e)")
    t.append(f"o AS (SELECT rid, string_agg(printf('%02x', CAST(m % 256 AS INT)), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)")
    t.append(f"s AS (SELECT sha256(string_agg(w, ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (SELECT part, e, unnest(range(len(c))) AS i, unnest(c)::BIGINT::VARCHAR AS w FROM b{rounds}))")
    return f"WITH {', '.join(t)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (rid), s"


ORACLE["op11_orchard_codes"] = _codes_sql()

# Rows after damage, their faults, and the best edits row by row: of all that reach a state of the pattern, the least cost and audit goes on.
# Insertions cost more than to delete their neighbours and are left out.
_BLANK = r"[^\x20\x09-\x0D]"
ORACLE["op13_turn_repair"] = rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(len(s)), lambda i: ascii(s[i + 1])::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 20 AS d FROM k),
r0 AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) FROM h WHERE d <> 0),
r1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini FROM r0),
r AS MATERIALIZED (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev, CASE WHEN NOT regexp_matches(text, '{_BLANK}') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM r1),
convs AS (SELECT DISTINCT conv_id FROM conversations),
e AS (SELECT * FROM (VALUES (0, 'K', 's', NULL, 1), (0, 'K', 'u', NULL, 2), (1, 'K', 'u', NULL, 2), (2, 'K', 'a', NULL, 3), (3, 'K', 'u', NULL, 2),
 (0, 'R', NULL, 'user', 2), (1, 'R', NULL, 'user', 2), (2, 'R', NULL, 'assistant', 3), (3, 'R', NULL, 'user', 2), (0, 'D', NULL, NULL, 0), (1, 'D', NULL, NULL, 1), (2, 'D', NULL, NULL, 2), (3, 'D', NULL, NULL, 3)) t(state, letter, ini, new, next)),
path AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM convs
 UNION ALL SELECT * FROM (SELECT p.conv_id, p.i + 1, e.next, p.cost + CASE e.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.letter <> 'D' AND r.fault = 3 THEN 5 ELSE 0 END, p.audit || e.letter AS audit_,
  CASE e.letter WHEN 'D' THEN p.said ELSE list_append(p.said, coalesce(e.new, r.role) || ':' || r.text) END
 FROM path p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN e ON e.state = p.state
 WHERE e.letter = 'D' OR (r.fault NOT IN (1, 2) AND (e.ini = r.ini OR e.new <> r.role))
 QUALIFY row_number() OVER (PARTITION BY p.conv_id, e.next ORDER BY p.cost + CASE e.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.letter <> 'D' AND r.fault = 3 THEN 5 ELSE 0 END, p.audit || e.letter) = 1)),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
 count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
best AS (SELECT p.* FROM path p LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(n.n, 0) AND p.state IN (0, 3) QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY cost, audit) = 1)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost::BIGINT AS cost, audit,
 sha256(array_to_string(said, chr(10))) AS repaired_sha256 FROM best b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id"""
