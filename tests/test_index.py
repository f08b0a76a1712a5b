"""The cell index against all pairs."""

import math

import numpy as np

from lexloom.operators import index, search

V = "vec_id long, embedding array<float>"


def plain(rows, k):
    out = []
    fine = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    for i, q in fine:
        if i % 7:
            continue
        near = sorted((math.sqrt(sum((float(np.float32(a)) - float(np.float32(b))) ** 2 for a, b in zip(q, v))), j) for j, v in fine if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, round(d, 5)) for r, (d, j) in enumerate(near)]
    return sorted(out)


def test_awkward_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.choice([-1.0, 0.0, 0.5, 2.0], 3)]) for i in range(120)]  # many ties and copies
    rows += [(200 + i, [float(i), 1.0]) for i in range(20)] + [(300, None), (301, []), (302, [float("nan"), 1.0, 1.0]), (303, [None, 1.0, 1.0]), (308, [5.0] * 9)]
    df = spark.createDataFrame(rows, V).repartition(4)
    built = index.build(df, f"{tmp_path}/cells", cells=6)
    got = index.search(built, df.filter("vec_id % 7 = 0"), 4, index.kept_in(spark, str(tmp_path / "notes")))
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.distance, 5)) for r in got.collect()) == plain(rows, 4)
    none = spark.createDataFrame([], V)
    empty = index.build(none, f"{tmp_path}/none")
    assert index.search(empty, df, 4, index.kept_in(spark, str(tmp_path / "notes"))).count() == 0
    assert index.search(built, none, 4, index.kept_in(spark, str(tmp_path / "notes"))).count() == 0


def test_clusters_are_read_in_part_and_exactly(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    centres = 4 * rng.standard_normal((30, 12))
    x = centres[rng.integers(0, 30, 4000)] + 0.4 * rng.standard_normal((4000, 12))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], V).repartition(4)
    asks, keep = df.filter("vec_id % 100 = 0"), index.kept_in(spark, str(tmp_path / "notes"))
    monkeypatch.setattr(index, "BLOCK", 50)  # cells of several blocks
    built = index.build(df, f"{tmp_path}/cells")
    want = sorted(map(tuple, search.top_k_of_queries(df, asks, 10).collect()))
    assert sorted(map(tuple, index.search(built, asks, 10, keep).collect())) == want
    share = index.read_shares(built, asks, 10, keep).first()
    assert share.n_queries == 40 and share.share < 0.2
    # Few cells, of which each query reads one or two: still exact.
    coarse = index.build(df, f"{tmp_path}/coarse", cells=3)
    assert sorted(map(tuple, index.search(coarse, asks, 10, keep).collect())) == want


def test_substrings_by_trigrams(spark, tmp_path):
    """Every needle finds what a scan finds; the postings of its own grams are all that is read."""
    import random

    from lexloom.functions.text import contains_ci
    from lexloom.operators import grams
    from pyspark.sql import functions as F

    rng = random.Random(4)
    said = lambda: None if rng.random() < 0.1 else "".join(rng.choice("abcAé %_ß") for _ in range(rng.randrange(12)))
    df = spark.createDataFrame([(i, said(), said(), rng.randrange(2000)) for i in range(600)], "id long, a string, b string, n int").repartition(3)
    built = grams.build(df, ["a", "b", "n"], str(tmp_path / "grams"), buckets=16)
    for needle in ["abc", "ABCA", "a%b", "_ß", "éé", "199", "1999", "", "zzz", "bca bc", "SS", "aß"]:
        want = sorted(r.id for r in df.filter(contains_ci(needle, F.col("a"), F.col("b"), F.col("n").cast("string"))).collect())
        assert sorted(r.id for r in grams.search(built, df, needle).collect()) == want, needle
    plan = grams.candidates(built, df, "abca")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert grams.candidates(built, df, "ab") is None
