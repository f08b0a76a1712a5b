"""Operators on small inputs whose results are known: fixed cases, nulls, ties, empty tables."""

import datetime as dt
import json
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.operators import catalog, chat, consolidate, extract, mutate, search, segment, tree
from lexloom.sources import rest, tables


def segmented(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "norma_id long, raw_text string")
    got = segment.segment(df).orderBy("norma_id", "ordem").collect()
    return [[(r.tipo, r.numero, r.texto, r.parent_ordem) for r in got if r.norma_id == i] for i in range(len(texts))]


def test_segments(spark):
    lines = ["Art. 1º um", "§ 1º dois", "I - tres", "a) quatro", "§ 2º cinco", "II - seis", "Art. 2º sete", "b) oito"]
    got = segmented(
        spark, "\n".join(lines), "Art.\n5. x", "Parágrafo único. o resto", "Vistos os autos", "XV – bar", "L - x", "antes 2020\nV - x\nArt. 3º y", "", None,
        "  Art. 1º recuado\nArt. 2º\n\n - \n\nfim", "art 7-A caixa", "1. item\nArt. 9º z", "curto 1/2\nab\nV - x",
    )
    assert [c[3] for c in got[0]] == [None, 0, 1, 2, 0, 4, None, 6] and [c[2] for c in got[0]] == "um dois tres quatro cinco seis sete oito".split()
    assert got[1] == [("artigo", "5", "", None)]  # the number also opens an item, which ends the article's slice
    assert got[2] == [("paragrafo", "único", "o resto", None)]
    assert got[3] == [("inciso", "V", "istos os autos", None)] and got[4] == [("inciso", "XV", "bar", None)] and got[5] == []
    assert got[6] == [("artigo", "3º", "y", None)]  # an incise after a date is none
    assert got[7] == got[8] == []
    assert got[9] == [("artigo", "2º", "fim", None)]
    assert got[10] == [("artigo", "7-A", "caixa", None)] and got[11] == [("artigo", "9º", "z", None)]
    assert got[12] == []


def test_positions_of_markers(spark):
    text = "cabeça\nArt. 1º  um\n\n continua\n§ 1º é dois\nfim"
    df = spark.createDataFrame([(1, text)], "norma_id long, raw_text string")
    found = segment.marker_scan(df).orderBy("pos").collect()
    assert [(r.kind, r.numero, r.texto) for r in found] == [("artigo", "1º", "um continua"), ("paragrafo", "1º", "é dois fim")]
    for r in found:
        assert text[r.pos : r.marker_end] == r.marker and r.end_pos == r.marker_end + len(r.texto)
    assert found[0].slice_end == found[1].pos and found[1].slice_end == len(text)


def test_a_long_norm_leaves_its_row_once(spark):
    """Shuffled bytes grow with the text, not with lines times text."""
    import time

    lines = "\n".join(f"Art. {i} texto do artigo numero {i} com algumas palavras" for i in range(20_000))
    df = spark.createDataFrame([(1, lines)], "norma_id long, raw_text string")
    began = time.time()
    assert segment.segment(df).count() == 20_000 and time.time() - began < 60
    plan = segment.segment(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "_s#" in plan and not any("raw_text" in x for x in plan.split("Window")[:-1])  # windows see no text of the norm


def test_actions_and_references(spark):
    said = [
        "Fica revogado o art. 3º", "REVOGA-SE a lei", "altera-se o inciso IV", "a revogação e a alteração da Lei", "Adiciona, substitui e regulamenta; inclui o que foi previsto nos termos",
        "ficam alteradas as regras, ficam  revogados os itens", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(said)), "id long, texto string")
    got = {}
    for r in extract.action_mentions(df).collect():
        assert said[r.id][r.start : r.start + len(r.hit)] == r.hit
        got.setdefault(r.id, []).append((r.start, r.acao, r.hit))
    names = {k: [(a, h) for _, a, h in sorted(v)] for k, v in got.items()}
    assert names == {
        0: [("REVOGA", "Fica revogado")], 1: [("REVOGA", "REVOGA")], 2: [("ALTERA", "altera")],
        4: [("ADICIONA", "Adiciona"), ("SUBSTITUI", "substitui"), ("REGULAMENTA", "regulamenta"), ("ADICIONA", "inclui"), ("REFERENCIA", "previsto"), ("REFERENCIA", "nos termos")],
        5: [("ALTERA", "ficam alteradas"), ("REVOGA", "ficam  revogados")],
    }
    cases = {
        "revoga a Lei nº 1.234/2020": [("lei", "1.234/2020", 0.9)], "revoga a Lei n. 1234/2020": [("lei", "./1234", 0.9)], "revoga o que diz a Lei 5, de 2020": [("lei", "5,", 0.7)],
        "revoga a lei 12345 inteira": [("lei", "12345", 0.7)], "revoga o Decreto-Lei 200/1967": [("lei", "200/1967", 0.9)], "altera a LC 10 2001 agora": [("lc", "10/2001", 0.9)],
        "altera o disposto desta Lei": [("self_reference", "", 0.95)], "altera algo da leiloeira sim": [("self_reference", "", 0.95)], "altera algo nesta Lei, sim": [("", "", 0.5)],
        "altera a alínea b) do art. 5º, inciso IV": [("artigo", "5º", 0.9), ("inciso", "IV", 0.9), ("alinea", "b", 0.9)],
        "altera o parágrafo único agora": [("paragrafo", "único", 0.9)], "altera o paragrafo unico agora": [("paragrafo", "unico", 0.9)], "altera o§ 2º deste ato todo": [("paragrafo", "2º", 0.9)],
        "altera o § 2º do ato todo já": [("", "", 0.5)],
    }
    texts = list(cases)
    rows = extract.events(spark.createDataFrame(list(enumerate(texts)), "id long, texto string")).filter("acao in ('REVOGA', 'ALTERA')").collect()
    for i, t in enumerate(texts):
        assert [(r.ref_tipo, r.ref_numero, r.confidence) for r in rows if r.id == i] == cases[t], t


CLAUSES = "id long, norma_id long, tipo string, numero string, texto string, ordem long, parent_ordem long"
EVENTS = "id long, acao string, source_norm_id long, target_norm_id long, target_clause_id long, created_at timestamp"
NORMS = "id long, tipo string, numero string, ano int, ementa string, data_publicacao date, data_vigencia date"


def small(spark):
    c = [(1, 10, "artigo", "1º", "um", 0, None), (2, 10, "paragrafo", "1º", "dois", 1, 0), (3, 10, "artigo", "2º", "tres", 2, None), (4, 11, "artigo", "1º", "outro", 0, None)]
    n = [(10, "Lei", "5", 2000, "resumo", dt.date(2000, 1, 2), None), (11, "Lei", "6", 2001, None, None, None), (12, "Decreto", "7", 2002, "", None, None), (13, "Decreto", "8", 2002, "", None, None)]
    return spark.createDataFrame(c, CLAUSES), spark.createDataFrame(n, NORMS)


def body(text):
    return text.split("\n\n")[-2].split("\n")[-10:] if text else text


def test_consolidation(spark):
    c, n = small(spark)
    t = lambda d: dt.datetime(2020, 1, d)
    e = [
        (1, "REVOGA", 11, 10, 1, t(1)),  # the parent goes and hides its child
        (2, "ALTERA", 12, 10, 2, t(1)), (3, "ALTERA", 11, 10, 3, t(2)), (4, "ALTERA", 12, 10, 3, t(1)),
        (5, "REVOGA", 10, 11, 3, t(3)),  # another norm's event that points here does nothing here
        (6, "REVOGA", 10, None, 4, t(3)), (7, "ALTERA", 10, 11, None, t(3)), (8, "REFERENCIA", 10, 11, 4, t(3)),
    ]
    events = spark.createDataFrame(e, EVENTS)
    lines = [(r.norma_id, r.line) for r in consolidate.lines(c, events, n).orderBy("norma_id", "ordem", "part").collect()]
    assert lines == [(10, "Art. 1º (REVOGADO)"), (10, "Art. 2º tres"), (10, "  [ALTERADO pela Lei 6/2001]"), (11, "Art. 1º outro")]
    stats = {r.norma_id: (r.n_clauses, r.n_revoked, r.n_altered, r.n_events) for r in consolidate.statistics(c, events).collect()}
    assert stats == {10: (3, 1, 2, 4), 11: (1, 1, 0, 3)}
    raw = spark.createDataFrame([(12, "texto bruto"), (10, "nunca usado")], "norma_id long, raw_text string")
    texts = {r.norma_id: r.consolidated_text for r in consolidate.texts(n, c, events, raw=raw).collect()}
    assert texts[12] == "texto bruto" and texts[13] is None and "EMENTA: resumo" in texts[10] and "EMENTA" not in texts[11] and "Eventos processados: 4" in texts[10]
    written = {r.id: (r.status, r.consolidated_text) for r in mutate.set_texts(n.withColumn("status", F.lit("segmented")), consolidate.texts(n, c, events)).collect()}
    assert written[10] == ("consolidated", texts[10]) and written[12] == ("segmented", None)
    none = events.limit(0)
    assert consolidate.lines(c, none, n).count() == 4 and consolidate.lines(c.limit(0), events, n).count() == 0


def test_paths_equal_a_walk(spark):
    import random

    rng = random.Random(2)
    rows, kinds = [], ["artigo", "paragrafo", "inciso", "alinea"]
    for norm in range(30):
        open_ = {}
        for i in range(40):
            k = rng.choice(kinds)
            a, p, inc = (open_.get(x, -1) for x in kinds[:3])
            above = p if p > a else a
            up = {"artigo": -1, "paragrafo": a, "inciso": above, "alinea": inc if inc > max(a, p) else above}[k]
            rows.append((norm * 100 + i, norm, k, str(i), "t", i, up if up >= 0 else None))
            open_[k] = i
    got = tree.paths(spark.createDataFrame(rows, CLAUSES).withColumn("odd", F.col("ordem") % 3 == 0), "odd").collect()
    by = {(r[1], r[5]): r for r in rows}
    for r in got:
        chain = [by[r.norma_id, r.ordem]]
        while chain[0][6] is not None:
            chain.insert(0, by[r.norma_id, chain[0][6]])
        assert r.ancestors == [x[5] for x in chain] and r.depth == len(chain) - 1 and r.path.count(" > ") == r.depth and r.path.endswith(chain[-1][3])
        assert r.under == any(x[5] % 3 == 0 for x in chain[:-1])
    assert len(got) == len(rows)


def test_searches(spark):
    v = [(1, 10, [1.0, 0.0]), (2, 10, [1.0, 0.0]), (3, 11, [0.0, 1.0]), (4, 11, None), (5, 11, []), (6, 12, [1.0 + 4e-7, 0.0])]
    c = spark.createDataFrame(v, "id long, norma_id long, embedding array<double>")
    got = search.top_k(c, [1.0, 0.0], 4).collect()
    assert [(r.id, r.distance, r.score) for r in got] == [(1, 0.0, 1.0), (2, 0.0, 1.0), (6, 0.0, 1.0), (3, 1.414214, 0.0)]
    assert search.top_k(c, [], 4).count() == search.top_k(c, None, 4).count() == search.top_k(c.limit(0), [1.0, 0.0]).count() == 0
    assert [r.id for r in search.top_k(c, [1.0, 0.0], 4, norm_id=11).collect()] == [3]
    near = spark.createDataFrame([(1, 1, [0.15 - 1e-8]), (2, 1, [0.15 + 1e-8])], "id long, norma_id long, embedding array<double>")
    assert [r.id for r in search.top_k(near, [0.0], 9, min_similarity=0.85).collect()] == [1]  # compared before rounding
    assert [r.id for r in search.top_k(c, [2.0, 0.0], 1, metric="cosine").collect()] == [1]
    assert catalog.coverage(c).first().with_embedding == 4
    assert search.context(spark.createDataFrame([], "rank long, shown string")).first().context == search.NO_CONTEXT
    hits = search.top_k(c, [1.0, 0.0], 2)
    asked = spark.createDataFrame([("p",)], "prompt string")
    failed = search.answers(asked, lambda p: F.lit(None).cast("string"), hits).first()
    assert (failed.answer, failed.confidence) == (search.FAILED_ANSWER, 0.0)
    assert search.answers(asked, search.stub_answer, hits).first().confidence == 1.0


def test_query_sets_and_cells(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 12)) + 3 * rng.integers(0, 2, (1500, 1))
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(5000, None), (5100, []), (5200, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = v.filter("vec_id % 100 = 0")
    want = {(i, k): int(j) for i in range(0, 1500, 100) for k, j in enumerate(np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[1:11], 1)}
    for size in (4096, 200):
        got = {(r.query_id, r.rank): r.vec_id for r in search.top_k_of_queries(v, q, 10, size).collect()}
        assert got == want
    cells = search.train_cells(v.filter("vec_id < 5000"), 8, sample=600)
    found = {(r.query_id, r.vec_id) for r in search.probe_queries(v.filter("vec_id < 5000"), q, cells, 5).collect()}
    true = {(i, j) for (i, _), j in want.items()}
    assert len(cells) == 8 and len(found & true) >= 0.9 * len(true)
    assert search.train_cells(v.limit(0), 8) == [] and search.top_k_of_queries(v.limit(0), q).count() == 0
    cells_of = search.assign_cells(v.filter("vec_id < 5000"), cells)
    assert search.probe(cells_of, cells, x[0].tolist(), 8).count() == 1500 > search.probe(cells_of, cells, x[0].tolist(), 1).count()


def test_recall_of_the_registered_index(spark):
    from lexloom.plans.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    true = {(r.query_id, r.vec_id) for r in QUERIES["vector_query_set"](spark, sf).collect()}
    found = {(r.query_id, r.vec_id) for r in QUERIES["ivf_query_set"](spark, sf).collect()}
    assert len(found & true) >= 0.9 * len(true)


def test_cached_embeddings(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, None)], "id long, text string")
    first = search.cached_embeddings(texts, spark.createDataFrame([], "cache_key string, embedding array<double>"), "m")
    assert {r.id: r.embedding is not None for r in first.collect()} == {1: True, 2: True, 3: False, 4: False}
    at = {1: "2024-01-01 00:00:00", 2: "2024-01-09 00:00:00"}
    cache = first.filter("id < 3").withColumn("stored_at", F.when(F.col("id") == 1, at[1]).otherwise(at[2]).cast("timestamp")).select("cache_key", "embedding", "stored_at")
    hits = {r.id: r.cache_hit for r in search.cached_embeddings(texts, cache, "m", now="2024-01-10 00:00:00").collect()}
    assert hits == {1: False, 2: True, 3: False, 4: False}


def test_mini_batches_of_skewed_ids(spark):
    ids = list(range(5000)) + [10**12 + i * 10**6 for i in range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    for rows in (200_000, 100):
        got = sorted((r.id, r.batch) for r in catalog.mini_batches(df, 64, rows_per_range=rows).collect())
        assert got == [(i, k // 64) for k, i in enumerate(ids)]
    assert catalog.mini_batches(df.limit(0), 64).count() == 0


def test_limits():
    assert schema.clamp_page(None, None) == (1, 20) and schema.clamp_page(-3, 1000) == (1, 100) and schema.clamp_page(4, 0) == (4, 20)
    assert schema.clamp_k(None) == 10 and schema.clamp_k(500) == 50 and schema.clamp_similarity(3) == 1.0 and schema.clamp_similarity(None) == 0.0
    for bad in (0, -1):
        with pytest.raises(ValueError):
            schema.clamp_k(bad)
    with pytest.raises(ValueError):
        schema.year_range(2001, 2000)
    assert schema.year_range(1999, 2000) == (1999, 2000)


def test_pages_beyond_the_end(spark):
    n = spark.createDataFrame([(i, "Lei", str(i), 2000, "x", "pending", None) for i in range(45)], "id long, tipo string, numero string, ano int, ementa string, status string, data_publicacao date")
    rows = catalog.page(n, 99, 20).collect()
    assert len(rows) == 5 and {(r.total, r.n_pages, r.has_next, r.has_prev) for r in rows} == {(45, 3, False, True)}
    assert catalog.page(n.limit(0), 1, 20).count() == 0


def test_budget_takes_a_prefix(spark):
    hits = spark.createDataFrame([(i, f"n{i}", "p", "x" * size, 0.5, float(i)) for i, size in enumerate((50, 60, 10))], "id long, norm_label string, path string, texto string, score double, distance double")
    assert [r.id for r in search.context_parts(hits, 30).collect()] == [0]


def test_ingest_rejects(spark):
    given = [
        {"id": 1, "tipo": "Lei", "numero": 5, "ano": 2020, "data": "2020-01-02", "texto_integral": "u"}, {"id": 2, "tipo": {"descricao": "Decreto"}, "data": "2001-02-30"},
        {"id": 3, "data": "soon"}, {"tipo": "Lei"}, {"id": 0}, {"id": 4, "data": None, "data_vigencia": "2020-13-01"},
    ]
    rows, bad = mutate.ingest_projection(spark.createDataFrame([(i, json.dumps(g)) for i, g in enumerate(given)] + [(9, "no json")], "arrival long, value string"))
    assert {(r.id, r.tipo, r.numero, str(r.published), r.pdf_url) for r in rows.collect()} == {(1, "Lei", "5", "2020-01-02", "u"), (3, "", "", "None", "")}
    assert {r.arrival: r.reason for r in bad.collect()} == {1: "impossible date", 3: "missing id", 4: "missing id", 5: "impossible date", 9: "missing id"}
    one = mutate.ingestion_summary(rows, bad, 3, 2).first()
    assert (one.n_pages, one.n_rows, one.n_failed, one.errors) == (3, 2, 5, "1: impossible date; 3: missing id")
    assert mutate.ingestion_summary(rows.limit(0), bad.limit(0)).first().errors == ""


def test_changes_of_tables(spark):
    e = spark.createDataFrame([(1, 10, 11), (2, 11, 10), (3, None, 12), (4, 12, None)], "id long, source_clause_id long, target_clause_id long")
    got = {(r.id, r.target_clause_id) for r in mutate.cascade(e, spark.createDataFrame([(10,), (10,)], "id long")).collect()}
    assert got == {(2, None), (3, 12), (4, None)}
    old, new = spark.createDataFrame([(1, "a", "ready"), (2, "b", "ready")], "id long, x string, status string"), spark.createDataFrame([(2, None, None), (3, "c", None)], "id long, x string, status string")
    assert {tuple(r) for r in mutate.upsert(old, new, status="pending").collect()} == {(1, "a", "ready", "kept"), (2, None, "pending", "updated"), (3, "c", "pending", "created")}
    assert mutate.upsert(old.limit(0), new.limit(0)).count() == 0
    v = mutate.set_vectors(spark.createDataFrame([(1, [1.0]), (2, None)], "id long, embedding array<double>"), spark.createDataFrame([(2, [2.0])], "id long, embedding array<double>"), "m", "2024-01-01")
    assert {(r.id, r.embedding_model, r.embedded_at is not None) for r in v.collect()} == {(1, None, False), (2, "m", True)}
    q = spark.createDataFrame([(1, 7, 3, "w" * 80), (2, 8, 3, "x")], "request_id long, user_id long, asked long, question string")
    s = spark.createDataFrame([(3, 8, 1)], "session_id long, user_id long, updated_at long")
    assert {tuple(r) for r in chat.get_or_create(q, s).collect()} == {(1, 7, -2, True, "w" * 50), (2, 8, 3, False, None)}


class Answer:
    def __init__(self, body):
        import io

        self.body = io.BytesIO(body)

    def read(self, *n):
        return self.body.read(*n)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def server(script, calls):
    """An opener that answers from a list: bytes, or a status to fail with."""

    def opener(request, timeout=None):
        calls.append((request.full_url, request.headers.get("User-agent")))
        got = script.pop(0)
        if isinstance(got, int):
            raise urllib.error.HTTPError(request.full_url, got, "no", {}, None)
        return Answer(got)

    return opener


def page(*ids):
    return json.dumps({"count": len(ids), "results": [{"id": i, "tipo": "Lei", "numero": str(i), "ano": 2020, "ementa": "e"} for i in ids]}).encode()


def reader(script, calls, **options):
    opener = server(script, calls)
    return rest.NormReader({"endpoint": "http://x/normas/", "page_size": "2", **options}, lambda url, turn=0: rest.get_json(url, turn, wait=0, opener=opener))


def test_rest_pages():
    calls = []
    r = reader([page(1, 2), page(2, 3), page(2, 3)], calls)
    assert [x[0] for x in r.read(r.partitions()[0])] == [1, 2, 3]  # a page of nothing new ends it
    assert [u.split("?")[1] for u, _ in calls] == ["limit=2&offset=0", "limit=2&offset=2", "limit=2&offset=4"]
    assert len({a for _, a in calls}) == 3  # agents rotate
    assert list(reader([page()], []).read(rest.Part())) == []
    assert [x[0] for x in reader([page(1, 2)], [], max_rows="1").read(rest.Part())] == [1]
    kind = json.dumps({"results": [{"id": 7, "tipo": {"descricao": "Decreto"}, "numero": 5, "ano": 2021}]}).encode()
    assert [x[:5] for x in reader([kind, page()], []).read(rest.Part())] == [(7, "Decreto", "5", 2021, None)]


def test_rest_errors():
    calls = []
    assert [x[0] for x in reader([503, 429, page(1), page()], calls).read(rest.Part())] == [1] and len(calls) == 4  # transient: tried again
    with pytest.raises(urllib.error.HTTPError):
        list(reader([500, 500, 500], []).read(rest.Part()))  # the first page decides whether there is a source at all
    with pytest.raises(urllib.error.HTTPError):
        list(reader([403], []).read(rest.Part()))
    assert [x[0] for x in reader([page(1, 2), 403], []).read(rest.Part())] == [1, 2]  # what came before stands
    with pytest.raises(ValueError):
        list(reader([b"no json"], []).read(rest.Part()))


def test_rest_by_id_and_filters():
    from pyspark.sql.datasource import EqualTo

    calls = []
    r = reader([json.dumps({"id": 42, "tipo": "Lei", "numero": "999", "ano": 2023}).encode(), 404], calls)
    assert len(list(r.pushFilters([EqualTo(("id",), 42)]))) == 1 and [p.value for p in r.partitions()] == [(None, 42)]
    assert [x[:4] for x in r.read(r.partitions()[0])] == [(42, "Lei", "999", 2023)] and calls[0][0] == "http://x/normas/42/"
    assert list(r.read(rest.Part(ident=99999))) == []
    r = reader([page()], calls, from_year="2019", to_year="2021")
    assert [p.value for p in r.partitions()] == [(2019, None), (2020, None), (2021, None)]
    list(r.pushFilters([EqualTo(("ano",), 2020), EqualTo(("tipo",), "Lei")]))
    assert [p.value for p in r.partitions()] == [(2020, None)] and list(r.read(r.partitions()[0])) == []
    assert "ano=2020&tipo=Lei" in calls[-1][0]


def test_rest_source(spark, tmp_path):
    pages = spark.createDataFrame([("2019-0.json", page(1, 2).decode()), ("2019-1.json", page(3).decode()), ("2020-0.json", page(3, 4).decode())], "name string, body string")
    assert rest.write_pages(pages, str(tmp_path)) == 3
    got = rest.of_years(spark, str(tmp_path), 2018, 2021, 2)
    assert sorted((r.id, r.asked) for r in got.collect()) == [(1, 2019), (2, 2019), (3, 2019), (4, 2020)]
    x = spark.read.format("rest_norms").option("endpoint", str(tmp_path)).option("from_year", 2019).option("to_year", 2020).option("page_size", 2).load()
    assert [r.id for r in tables.by_id(x, 4).collect()] == [4] and x.filter("tipo = 'Decreto'").count() == 0 and rest.first_rows(x).count() == 5


def test_downloads(spark, tmp_path):
    (tmp_path / "src").write_bytes(b"%PDF" * 10_000)
    out = tmp_path / "out"
    out.mkdir()
    files = spark.createDataFrame([(1, f"file://{tmp_path}/src"), (2, f"file://{tmp_path}/none"), (3, "no address")], "id long, url string")
    got = {r.id: r for r in rest.download(files, str(out)).collect()}
    assert got[1].n_bytes == 40_000 and (out / "1.pdf").read_bytes() == b"%PDF" * 10_000 and got[1].error is None
    assert got[2].path is None and got[2].error and got[3].error and sorted(p.name for p in out.iterdir()) == ["1.pdf"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.txt").write_text("um\fdois")
    assert [(r.page_no, r.text) for r in tables.pages_of_text(spark, str(tmp_path / "p")).orderBy("page_no").collect()] == [(1, "um"), (2, "dois")]


def test_versioned_upsert_counts_late_rows(spark, tmp_path):
    from lexloom.streaming import ingest

    cols = "event_id long, ts timestamp, event_type string, value double"
    t = lambda d: dt.datetime(2024, 1, d)
    batches = [[(1, t(10), "a", 1.0), (2, t(10), "a", 1.0)], [(3, t(1), "late", 1.0), (1, t(12), "b", 2.0)], [(1, t(11), "old", 9.0), (2, t(10), "a", 1.0)]]
    for n, rows in [*enumerate(batches), (2, batches[2])]:  # the last one is run again
        ingest.upsert_batch(spark.createDataFrame(rows, cols), n, str(tmp_path))
    got = {(r.event_id, r.event_type) for r in ingest.latest_version(spark, str(tmp_path), cols + ", v int").collect()}
    assert got == {(1, "b"), (2, "a"), (3, "late")}


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from lexloom import session

    class Context:
        master = "spark://x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError):
        session.shared_folder(Session())
    assert session.shared_folder(spark)


def test_matches_in_one_pass(spark):
    """Marks in the text itself, letters that fold to i, and texts without any sign."""
    pattern = extract.any_of(extract.ACTIONS.values())
    texts = ["", "nada", "Fica\x01 revoga\x01 altera", "revogar e alterar $1 \\ disposto", "D\u0130SPOSTO na lei", "D\u0131sposto", "inalterado", "a revoga", "revoga", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, texto string")
    got = {(r.id, r.start, r.hit) for r in extract.action_mentions(rows).collect()}
    split, found = F.split("texto", pattern, -1), F.regexp_extract_all("texto", F.lit(pattern), F.lit(0))
    want = set()
    for r in rows.select("id", split.alias("g"), found.alias("h")).filter("g is not null").collect():
        at = 0
        for gap, hit in zip(r.g, r.h):
            want.add((r.id, at + len(gap), hit))
            at += len(gap) + len(hit)
    assert got == want and {i for i, *_ in got} >= {2, 3, 4, 5, 7, 8}


def test_references_without_keys_are_dealt_out(spark):
    from lexloom.operators import resolve

    refs = spark.range(4000).selectExpr("id", "id div 4 as norma_id", "'self_reference' as ref_tipo", "cast(null as string) as law_tipo", "cast(null as string) as law_numero", "cast(null as string) as law_ano")
    norms = spark.createDataFrame([(1, "Lei", "1", 2000)], "id long, tipo string, numero string, ano int")
    own = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(own, ("-1", "false")):
            spark.conf.set(k, v)
        out = resolve.resolve(refs, norms)
        assert out.filter("target_norm_id = norma_id").count() == 4000
        most = max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert most < 2000
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
