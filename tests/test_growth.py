"""Plans whose cost has to grow no faster than the input: what is parsed once, what does not travel, what is not one task."""

import json

from pyspark.sql import functions as F

from lexloom.operators import mutate


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def payloads(spark):
    given = [{"id": 5, "tipo": "Lei", "data": "2001-02-03"}, {"tipo": {"descricao": "Lei"}}, {"id": 7, "data": "2001-02-30"}, {"id": 6, "tipo": {"descricao": "LC"}}]
    return spark.createDataFrame([(i, json.dumps(g)) for i, g in enumerate(given)] + [(9, "no json"), (10, None)], "arrival long, value string")


def test_payloads_are_parsed_once(spark):
    rows, bad = mutate.ingest_projection(payloads(spark))
    for x in (rows, bad, rows.filter("id % 3 <> 0")):
        assert executed(x).count("from_json(") == 1
    assert sorted(r.id for r in rows.collect()) == [5, 6] and sorted((r.arrival, r.reason) for r in bad.collect()) == [(1, "missing id"), (2, "impossible date"), (9, "missing id"), (10, "missing id")]
    got = mutate.checked_summary(mutate.checked_payloads(payloads(spark)), 4, 2)
    assert executed(got).count("from_json(") == 2 and tuple(got.first()) == (2, 2, 4, "1: missing id; 2: impossible date")
    assert mutate.ingestion_summary(rows, bad, 4, 2).first() == got.first()


def test_upserted_columns_keep_their_payload_without_a_join(spark):
    p = payloads(spark)
    got = mutate.norm_columns(p.unionByName(p.filter("arrival = 3")))  # an arrival that repeats is two rows, not four
    assert "Join" not in executed(got) and executed(got).count("from_json(") == 1
    assert sorted((r.id, json.loads(r.metadata)["id"], r.status) for r in got.collect()) == [(5, 5, "pending"), (6, 6, "pending"), (6, 6, "pending")]


def test_postings_are_written_a_gram_and_batch(spark, tmp_path):
    """Two thousand rows that have all their grams in common are a few postings, and repeats and short and odd texts count right."""
    from lexloom.operators import grams

    df = spark.createDataFrame([(i, "abcabc ß\U0001f600é" if i % 2 else "ab") for i in range(2000)] + [(-1, None), (-2, "")], "id long, a string").coalesce(1)
    built = grams.build(df, ["a"], str(tmp_path / "grams"), buckets=4)
    x = spark.read.parquet(built.path)
    assert x.count() <= 40 and x.agg(F.sum(F.size("ids"))).first()[0] == 1000 * 8  # the sharp s is two letters in capitals
    for needle, n in (("bcab", 1000), ("SS\U0001f600É", 1000), ("cba", 0), ("ab", 2000)):
        assert grams.search(built, df, needle).count() == n, needle


def test_events_without_a_target_clause_are_not_one_task(spark):
    e = spark.createDataFrame([(i, i, None if i % 2 else i + 1) for i in range(40)], "id long, source_clause_id long, target_clause_id long")
    got = mutate.cascade(e, spark.createDataFrame([(10,), (11,), (11,)], "id long"))
    assert "coalesce(target_clause_id" in executed(got)
    want = {(i, None if i % 2 or i + 1 in (10, 11) else i + 1) for i in range(40) if i not in (10, 11)}
    assert got.count() == 38 and {(r.id, r.target_clause_id) for r in got.collect()} == want


def acts(spark):
    from lexloom.operators import tree

    c = spark.createDataFrame([(n * 100 + o, n, "artigo" if o % 3 == 0 else "paragrafo", str(o), o, None if o % 3 == 0 else o // 3 * 3) for n in range(6) for o in range(5)], "id long, norma_id long, tipo string, numero string, ordem long, parent_ordem long")
    c = tree.paths(c)
    i, target = F.col("id"), F.when(F.col("id") % 4 == 0, F.col("id") + 1).when(F.col("id") % 4 == 1, F.col("id") + 101)
    own = [F.col("norma_id").alias("source_norm_id"), F.when(i % 3 == 0, F.lit("REVOGA")).otherwise("ALTERA").alias("acao"), F.when(i % 5 < 3, i % 7).alias("target_norm_id"), target.alias("target_clause_id"), F.lit("cujo texto").alias("target_text")]
    e = c.select("id", i.alias("source_clause_id"), *own)
    return c, e, c.select("id", *own, i.alias("source_clause_id"), "tipo", "numero", "path"), spark.createDataFrame([(n, "Lei", str(n), 2000) for n in range(6)], "id long, tipo string, numero string, ano int")


def test_events_that_carry_their_source_are_not_joined_with_it(spark):
    from lexloom.operators import links

    c, e, rich, n = acts(spark)
    names = ["id", "acao", "source_label", "source_norm", "target_label", "target_owner", "target_norm"]
    plain, own = links.event_chain(e, c, n).select(names), links.event_chain(links.sourced(rich.drop("path")), c, n).select(names)
    assert executed(own).count("Join ") < executed(plain).count("Join ")
    assert sorted(map(str, own.collect())) == sorted(map(str, plain.collect())) and own.count() == 30
    assert "isnotnull(target_clause_id" in executed(plain)


def test_labels_of_events_that_carry_their_source(spark):
    from lexloom.operators import links

    c, e, rich, n = acts(spark)
    plain, own = links.event_labels(e, c, n), links.event_labels(links.sourced(rich, "path"), c, n)
    assert executed(own).count("Join ") < executed(plain).count("Join ")
    got = sorted(map(str, own.collect()))
    assert got == sorted(map(str, plain.collect())) and len(got) == 30 and any("cujo texto" in x for x in got) and any(" da Lei" in x for x in got)


def test_a_walk_writes_down_only_rows_that_go_on(spark, tmp_path):
    from lexloom.operators import index, tree

    c = spark.createDataFrame([(i, 0, "artigo", str(i), i, i - 1 if 0 < i < 6 else None) for i in range(40)], "id long, norma_id long, tipo string, numero string, ordem long, parent_id long")
    written, kept = [], index.kept_in(spark, str(tmp_path))

    def keep(df):
        written.append(kept(df))
        return written[-1]

    got = tree.walk(c, keep, own=["norma_id"])
    assert [x.count() for x in written] == [40, 5, 4, 2] and "Join" not in executed(got)
    assert {(r.id, r.depth) for r in got.collect()} == {(i, i if i < 6 else 0) for i in range(40)} and got.columns[:2] == ["id", "norma_id"]


def test_a_walk_inside_norms_takes_rounds_only_for_parents_elsewhere(spark, tmp_path):
    """Equal to the plain walk on trees that cross norms, have cycles in and across norms, parents that are not there and rows without labels."""
    import random

    from lexloom.operators import index, tree

    rng, rows = random.Random(8), []
    for norm in range(40):
        for i in range(rng.choice([1, 3, 60])):
            up = None if i == 0 or rng.random() < 0.1 else 100 * norm + rng.randrange(i)
            rows.append([100 * norm + i, norm, rng.choice(["artigo", None]), str(i), i, up, rng.random() < 0.1])
    inner = spark.createDataFrame(list(map(tuple, rows)), "id long, norma_id long, tipo string, numero string, ordem long, parent_id long, revoked boolean")
    by = {r[0]: r for r in rows}
    for child, up in ((100, 0), (200, 100), (300, 400), (400, 300), (500, 500), (600, 99_999), (700, 600), (800, 801), (801, 800)):
        if child in by:
            by[child][5] = up
    odd = spark.createDataFrame(list(map(tuple, rows)), inner.schema).repartition(7)
    written, kept = [], index.kept_in(spark, str(tmp_path))

    def keep(df):
        written.append(kept(df))
        return written[-1]

    shown = lambda df: sorted(map(str, df.select("id", "norma_id", "tipo", "revoked", "ancestors", "path", "depth", "under", "cyclic").collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10000", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            written.clear()
            got = tree.walk(inner, keep, "revoked", within="norma_id")
            assert shown(got) == shown(tree.walk(inner, kept, "revoked")) and len(written) == 1 and "Exchange" not in executed(got)
            assert shown(tree.walk(odd, keep, "revoked", within="norma_id")) == shown(tree.walk(odd, kept, "revoked")) and len(written) > 2
            assert tree.walk(inner.limit(0), keep, within="norma_id").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_lines_leave_clauses_where_they_lie(spark):
    """Clauses and events that lie together by norm: the events move once, to the norm they change, and no text moves."""
    from lexloom.operators import consolidate

    c = spark.range(400).selectExpr("id", "id div 5 as norma_id", "'artigo' as tipo", "cast(id % 5 as string) as numero", "id % 5 as ordem", "'t' as texto", "cast(null as long) as parent_ordem").repartition("norma_id")
    e = c.selectExpr("id", "norma_id as source_norm_id", "if(id % 2 = 0, 'REVOGA', 'ALTERA') as acao", "(id * 7 % 400) div 5 as target_norm_id", "id * 7 % 400 as target_clause_id", "timestamp'2020-01-01' as created_at")
    n = spark.createDataFrame([(i, "Lei", str(i), 2000) for i in range(80)], "id long, tipo string, numero string, ano int")
    got = consolidate.lines(c, e, n)
    assert executed(got).count("Exchange hashpartitioning(norma_id") <= 3 and executed(got).count("Exchange hashpartitioning(norma_id#") == executed(got).count("REPARTITION_BY_COL")
    lines = {(r.norma_id, r.ordem, r.part): r.line for r in got.collect()}
    for i in range(400):
        by = (i * 343 % 400)  # 7 and 343 are inverses modulo 400
        at = (i // 5, i % 5)
        assert lines[(*at, 0)] == (f"Art. {i % 5} (REVOGADO)" if by % 2 == 0 else f"Art. {i % 5} t")
        assert lines.get((*at, 1)) == (None if by % 2 == 0 else f"  [ALTERADO pela Lei {by // 5}/2000]")


def test_details_are_sorted_without_texts_and_vectors(spark):
    from lexloom.operators import catalog

    c = spark.createDataFrame([(1, 1, "artigo", "2º", "abc", None), (1, 0, "artigo", "1º", None, [1.0]), (1, 2, None, "3", "é", []), (2, 0, "artigo", "1º", None, None)], "norma_id long, ordem long, tipo string, numero string, texto string, embedding array<float>")
    n = spark.createDataFrame([(i, "Lei", str(i), 2000) for i in (1, 2, 3)], "id long, tipo string, numero string, ano int")
    got = catalog.detail(n, c)
    plan = got._jdf.queryExecution().optimizedPlan()
    rows = [plan.apply(i) for i in range(40) if plan.apply(i) is not None and plan.apply(i).nodeName() == "Aggregate"]
    assert len(rows) == 1 and not {"texto", "embedding"} & {x.name() for x in map(rows[0].inputSet().toSeq().apply, range(rows[0].inputSet().size()))}
    shown = {r.id: ([(x.ordem, x.label, x.has_embedding) for x in r.clauses or []], r.n_clauses, r.n_chars, r.n_embedded) for r in got.collect()}
    assert shown[1][0][:2] == [(0, "Art. 1º", True), (1, "Art. 2º", False)] and shown[1][0][2][2] and shown[1][1:] == (3, 4, 2)
    assert shown[2] == ([(0, "Art. 1º", False)], 1, None, 0) and shown[3] == ([], None, None, None)


def test_ancestors_come_in_batches_of_bounded_size():
    import pyarrow as pa

    from lexloom.operators import tree

    n = 50
    rows = pa.RecordBatch.from_pydict({
        "id": pa.array(range(n), pa.int64()), "up": pa.array([None, *range(n - 2), n - 1], pa.int64()), "ordem": pa.array([*range(n - 1), None], pa.int64()),
        "path": pa.array([str(i) for i in range(n)]), "flag": pa.array([i == 3 for i in range(n)]), "own": pa.array(["x"] * n),
    })
    got = list(tree.climb(rows, most=200))
    assert len(got) > 6 and all(b["ids"].flatten().__len__() <= 200 for b in got)
    rows = [r for b in got for r in b.to_pylist()]
    for i, r in enumerate(rows[:-1]):
        assert r["ancestors"] == r["ids"] == list(range(i + 1)) and r["path"] == " > ".join(map(str, range(i + 1))) and r["under"] == (i > 3) and r["up"] is None
    assert rows[-1] == {"id": 49, "up": None, "ids": None, "ancestors": None, "path": None, "flag": False, "under": None, "cyclic": True, "own": "x"}


def test_consolidated_texts_move_no_clauses(spark):
    """Clauses that lie together by norm: what moves are events, norms and counts."""
    from lexloom.operators import consolidate

    c = spark.createDataFrame([(i, i // 5, "artigo", str(i), i % 5, f"t{i}", None) for i in range(40)], "id long, norma_id long, tipo string, numero string, ordem long, texto string, parent_ordem long").repartition("norma_id")
    e = spark.createDataFrame([(1, 1, "ALTERA", 2, 10, None)], "id long, source_norm_id long, acao string, target_norm_id long, target_clause_id long, created_at timestamp")
    n = spark.createDataFrame([(i, "Lei", str(i), 2000, None, None, None) for i in range(9)], "id long, tipo string, numero string, ano int, ementa string, data_publicacao date, data_vigencia date")
    got = consolidate.texts(n, c, e)

    def moved(plan):
        own = [[a.name() for a in map(plan.output().toSeq().apply, range(plan.output().size()))]] if plan.nodeName() == "Exchange" else []
        return own + [x for i in range(plan.children().size()) for x in moved(plan.children().apply(i))]

    names = moved(got._jdf.queryExecution().executedPlan().initialPlan())
    assert sum("texto" in x for x in names) == 1 and len(names) > 3  # the repartition above
    texts = {r.norma_id: r.consolidated_text for r in got.collect()}
    assert len(texts) == 8 and "Art. 10 t10\n  [ALTERADO pela Lei 1/2000]\nArt. 11 t11" in texts[2]


def test_consolidated_text_shuffles_the_lines_once(spark, tmp_path):
    """Clauses and events of clauses with a norm come from one shuffle of the table; events of lines without an order count as before."""
    import os

    from pyspark.sql import functions as F

    from lexloom.operators import consolidate
    from lexloom.plans import queries
    from lexloom.sources import bridge

    d = "/root/testdata/sf0.001"
    for name in os.listdir(d):
        os.symlink(f"{d}/{name}", tmp_path / name)
    os.unlink(tmp_path / "lineitem.parquet")
    spark.read.parquet(f"{d}/lineitem.parquet").withColumn("l_orderkey", F.expr("if(l_partkey % 50 < 2, null, l_orderkey)")).write.parquet(f"{tmp_path}/lineitem.parquet")
    at = str(tmp_path)
    c = queries.linked(spark, at)
    own, shared = bridge.alteration_events(c), bridge.shared_events(c)
    assert own.filter("source_norm_id is null and target_norm_id is not null").count() and sorted(map(str, own.collect())) == sorted(map(str, shared.collect()))
    plain = consolidate.texts(bridge.norms(spark, at), c, own, queries.STAMP)
    assert sorted(map(str, plain.collect())) == sorted(map(str, queries.consolidated_text(spark, at).select(plain.columns).collect()))

    got = queries.consolidated_text(spark, d)
    got.collect()
    final = got._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    assert len([x for x in final.splitlines() if " Exchange hashpartitioning(l_orderkey" in x.replace("+- Exchange", " Exchange") and "Reused" not in x]) == 1
