"""Trees of any depth, deep pages, slugs, the embedding job, against plain versions."""

import datetime as dt
import functools
import io
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import catalog, chat, embedding, extract, index, search, tree
from lexloom.sources import tables

CLAUSE = "id long, norma_id long, tipo string, numero string, ordem long, parent_id long, revoked boolean"


@pytest.fixture
def keep(spark, tmp_path):
    return index.kept_in(spark, str(tmp_path / "notes"))


def test_walks_of_deep_trees_and_cycles(spark, keep):
    rng = random.Random(3)
    rows = []
    for norm in range(12):
        for i in range(60):
            up = None if i == 0 or rng.random() < 0.1 else i - 1 if rng.random() < 0.8 else rng.randrange(i)
            rows.append([100 * norm + i, norm, "artigo", str(i), i, None if up is None else 100 * norm + up, rng.random() < 0.05])
    rows[5][5] = rows[9][0]  # 9 comes to hang below 5, and 5 on 9
    rows[9][5] = rows[5][0]
    rows[30][5] = rows[30][0]  # on itself
    rows[70][5] = 99_999  # on a clause that is not there
    df = spark.createDataFrame([tuple(r) for r in rows], CLAUSE).repartition(5)
    by = {r[0]: r for r in rows}

    def chain(r):
        out = [r]
        while (up := out[0][5]) is not None and up in by:
            if up in {x[0] for x in out}:
                return None
            out.insert(0, by[up])
        return out

    want = {r[0]: chain(r) for r in rows}
    assert max(len(c) for c in want.values() if c) > 12 and sum(c is None for c in want.values()) > 2
    for r in tree.walk(df, keep, "revoked").collect():
        c = want[r.id]
        assert r.cyclic == (c is None)
        if c:
            assert r.ancestors == [x[4] for x in c] and r.depth == len(c) - 1 and r.path == " > ".join(f"Art. {x[3]}" for x in c)
            assert r.under == any(x[6] for x in c[:-1])
        else:
            assert r.ancestors is None and r.path is None and r.depth is None

    def inner(norm, up):
        return ", ".join(f"Art. {r[3]}" + (f"{{{s}}}" if (s := inner(norm, r[0])) else "") for r in rows if r[1] == norm and (r[5] if r[5] in by else None) == up and want[r[0]])

    got = {r.norma_id: r.outline for r in tree.outline(tree.walk(df, keep)).collect()}
    assert got == {n: inner(n, None) for n in range(12)}
    assert tree.walk(df.limit(0), keep).count() == 0 and tree.outline(tree.walk(df.limit(0), keep)).count() == 0


def test_slices_of_an_order(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 2000, 2001, 2002]), rng.choice([None, "1", "10", "2", "é"])) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, ano int, numero string").repartition(6)
    value = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, (v or "").encode())

    def compare(a, b):
        for x, y, down in ((value(a[1]), value(b[1]), True), (text(a[2]), text(b[2]), True), ((True, a[0]), (True, b[0]), False)):
            if x != y:
                return (-1 if x < y else 1) * (-1 if down else 1)
        return 0

    want = [r[0] for r in sorted(rows, key=functools.cmp_to_key(compare))]
    for offset, size in ((0, 5), (1490, 30), (2990, 50), (0, 3000), (5000, 3), (700, 1500)):
        got = [r.id for r in catalog.slice_of(df, catalog.DEFAULT, offset, size, most=100, fan=16).collect()]
        assert got == want[offset : offset + size], (offset, size)
    # What is sorted in the end is the slice's own range.
    plan = catalog.slice_of(df, [("id", False)], 2900, 10, most=100, fan=16)
    assert plan._jdf.queryExecution().optimizedPlan().stats() is not None
    inner = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in inner and int(inner.split("GlobalLimit ")[1].split("\n")[0]) == 10 and int(inner.split("Offset ")[1].split("\n")[0].split(",")[0]) < 400


def test_slugs_are_unique_whatever_collides(spark, keep):
    sessions = spark.range(200).withColumnRenamed("id", "session_id")
    taken = spark.createDataFrame([(f"{i:02x}",) for i in range(0, 40)], "slug string")
    got = chat.unique_slugs(sessions, taken, keep, 2).collect()
    assert len(got) == 200 == len({r.slug for r in got}) and not {r.slug for r in got} & {f"{i:02x}" for i in range(40)}
    first = {r.session_id: r.s for r in sessions.select("session_id", F.substring(X.slug(F.col("session_id")), 1, 2).alias("s")).collect()}
    assert sum(first[r.session_id] == r.slug for r in got) > 80  # those without a conflict keep their first
    assert sorted(map(tuple, chat.unique_slugs(sessions, taken, keep, 2).collect())) == sorted(map(tuple, got))
    with pytest.raises(ValueError, match="too short"):
        chat.unique_slugs(sessions, taken, keep, 1)
    assert chat.unique_slugs(sessions.limit(0), taken, keep).count() == 0


def recorded(folder):
    """A provider that notes what it was asked, in files, since tasks run in other processes; a closure, which travels whole."""

    def provider(texts):
        import json
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            json.dump(texts, f)
        if "slow" in texts:
            raise TimeoutError("no answer")
        return [None if t == "bad" else [float(len(t)), 1.0] for t in texts]

    return provider


def test_embedding_job_asks_once_and_writes_back(spark, keep, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    asked = lambda: Counter(t for p in calls.iterdir() for t in set(json.loads(p.read_text())))
    rows = [(i, t, None) for i, t in enumerate(["a", "bb", "bb", "bb", "", " \n", None, "bad", "slow", "ccc"] * 5)] + [(100, "has one", [9.0])]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<float>").repartition(4)
    cache = spark.createDataFrame([], "cache_key string, embedding array<double>, stored_at timestamp")
    job = lambda x, c, now, **more: embedding.embed(x, c, recorded(str(calls)), "m", now, keep, wait=0.0, tries=2, **more)
    done, kept, report = job(df, cache, "2024-01-01 00:00:00", batch=2)
    got = {r.id: (r.embedding, r.embedding_model) for r in done.collect()}
    assert got[1] == ([2.0, 1.0], "m") and got[0] == ([1.0, 1.0], "m") and got[100] == ([9.0], None) and got[7] == got[8] == got[4] == got[6] == (None, None)
    assert tuple(report.first()) == (50, 15, 5, 0, 3, 2) and kept.count() == 3
    assert asked()["bb"] <= 3 and "has one" not in asked()  # once, but for batches that were tried again
    for p in calls.iterdir():
        p.unlink()
    # Again: nothing to compute but what failed; rows without a vector are found in the cache while it lives.
    again, kept, report = job(done, kept, "2024-01-02 00:00:00")
    assert set(asked()) == {"bad", "slow"} and tuple(report.first()) == (25, 15, 2, 0, 0, 2)
    fresh = df.filter("text in ('a', 'ccc')")
    assert tuple(job(fresh, kept, "2024-01-07 23:59:59")[2].first()) == (10, 0, 2, 2, 0, 0)
    later, kept, report = job(fresh, kept, "2024-01-08 00:00:00")
    assert tuple(report.first()) == (10, 0, 2, 0, 2, 0)
    assert {r.stored_at for r in kept.collect()} == {dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8)} and kept.count() == 3
    assert job(done, kept, "2024-01-08 01:00:00", force=True)[2].first().n_rows == 51


def test_http_provider(spark):
    seen = []

    def opener(request, timeout):
        seen.append((json.loads(request.data), timeout))
        if json.loads(request.data)["prompt"] == "late":
            raise TimeoutError
        return io.BytesIO(json.dumps({"embedding": [0.5, 1.5]} if json.loads(request.data)["prompt"] != "none" else {}).encode())

    provider = embedding.HttpProvider("http://x/", "m", 7.0, opener)
    assert embedding.ask(provider, ["ok", "none"], 2, 0.0) == [[0.5, 1.5], None] and seen[0] == ({"model": "m", "prompt": "ok"}, 7.0)
    assert embedding.ask(provider, ["ok", "late", "ok"], 2, 0.0) == [[0.5, 1.5], None, [0.5, 1.5]]


def test_white_space_at_the_ends_does_not_count(spark):
    t = spark.createDataFrame([("\n" * 150,), ("x" * 100 + "\t\x0b" * 30,), ("x" * 101 + " ",), (None,)], "t string")
    assert [r[0] for r in t.select(tables.needs_ocr(F.col("t"))).collect()] == [True, True, False, True]
    assert [r[0] for r in t.select(tables.accepted_text(F.col("t"))).collect()] == [False, True, True, False]
    c = spark.createDataFrame([(1, 1, "Fica revogado." + "\n" * 20), (2, 1, "\t\n Fica revogado o item.")], "id long, norma_id long, texto string")
    assert [r.id for r in extract.events(c).collect()] == [2]
    p = spark.createDataFrame([("q", 1)], "prompt string, n int")
    assert search.answers(p, lambda c: F.lit("\n\t resposta \n")).first().answer == "resposta"


def test_slugs_beyond_those_of_hex_characters(spark, keep):
    sessions = spark.range(600).select(F.col("id").alias("session_id"))
    taken = spark.createDataFrame([(f"{i:02x}",) for i in range(40)], "slug string")
    got = {r.slug for r in chat.unique_slugs(sessions, taken, keep, 2).collect()}  # there are 256 of hex characters
    assert len(got) == 600 and {len(s) for s in got} == {2} and not got & {f"{i:02x}" for i in range(40)}
    with pytest.raises(ValueError):
        chat.unique_slugs(spark.range(4000).select(F.col("id").alias("session_id")), taken, keep, 2)


def test_parents_from_the_path(spark):
    from lexloom.operators import links, tree
    from lexloom.sources import bridge

    c = bridge.with_parents(bridge.clauses(spark, "/root/testdata/sf0.001"))
    x = tree.paths(c, parent=True)
    assert x.count() > 1000 and x.filter("parent_label is not null").count() > 100
    shown = ["id", "path", "parent_label"]
    a, b = x.select(shown), links.with_parent(tree.paths(c)).select(shown)
    assert not a.exceptAll(b).count() and not b.exceptAll(a).count()
    plan = links.with_norm(x, bridge.norms(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
