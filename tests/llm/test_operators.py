"""Operators of the llm subpackage against brute force on small inputs, awkward rows included."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("lexloom.llm")

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int"


def awkward():
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(50)}" for _ in range(20000))
    texts = [None, "", " \t\n", "a", "a b", "A B c", long, long, "x\ny\nx\ny", "<|endoftext|> ½ \x1c end", "é" * 30, "<|end|> \\ <|turn|>"]
    texts += [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(40))) for _ in range(60)]
    return [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, i, 0) for i, t in enumerate(texts)] + [(3, "a", "en", "s0", 1, 3, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    from lexloom.llm import packing

    cut = packing.pieces(docs, path(), 64, with_ids=True)
    rows = packing.pack(cut, 64).collect()
    t = Tokenizer.from_file(path())
    for d, text, *_ in awkward():
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted({(r.piece, r.start, r.length, bytes(r.ids), r.ids_crc32) for r in rows if r.doc_id == d})
        assert b"".join(o[3] for o in own) == np.array(ids, "<u4").tobytes()
        assert all(o[2] == 64 for o in own[1:]) and all(zlib.crc32(o[3]) == o[4] for o in own)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r.length for r in rows) // 64) * 1.05 + 1
    assert packing.pack(packing.pieces(empty, path()), 1024).count() == 0


def test_packing_places_every_rank(spark):
    """Repeated and null ids, a length that a third of the pieces have, runs in bins, joined or broadcast."""
    from lexloom.llm import packing

    rng = random.Random(3)
    rows = [(None if i % 5 == 0 else 7 if i % 3 else i, 0, 0, 9 if i % 3 == 0 else rng.randrange(1, 65), 0) for i in range(9000)]
    cut = spark.createDataFrame(rows, packing.PIECES).repartition(3)
    for few in (100_000, 0):
        old, packing.FEW_RUNS = packing.FEW_RUNS, few
        got = packing.pack(cut, 64).collect()
        packing.FEW_RUNS = old
        assert sorted((str(r.doc_id), r.length) for r in got) == sorted((str(r[0]), r[3]) for r in rows)
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for v in by.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= 64
        assert len(by) <= -(-sum(r[3] for r in rows) // 64) * 1.03 + 1


def test_plan_uses_the_whole_histogram():
    from collections import Counter

    from lexloom.llm import packing

    rng = random.Random(1)
    for capacity in (7, 64, 300):
        h = Counter(min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(3000))
        got = Counter()
        for n, items in packing.plan(h, capacity):
            assert sum(items) <= capacity and n > 0
            for v in items:
                got[v] += n
        assert got == h


def test_chat(spark, docs, empty):
    from lexloom.llm import chat

    rows = [(i // 3, i % 3 if i % 7 else None, ("user", "assistant", "a\nb", None)[i % 4], d[1]) for i, d in enumerate(awkward())]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.conversations(df).withColumn("back", chat.read_back()).withColumn("loss", chat.loss_text()).collect()
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert len(got) == len(by)
    for r in got:
        want = sorted(by[r.conv_id])
        assert [(b.role, b.text) for b in r.back] == [w[2:] for w in want]
        assert r.loss == "".join(w[3] for w in want if w[2] == "assistant")
    assert chat.conversations(df.limit(0)).count() == 0
    records = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"completion":"a","prompt":"q"}', '{"instruction":"q","input":"","output":"a"}', '{"other":1}', "not json", None]
    out = chat.canonical(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert [[(t.role, t.text) for t in r.turns or []] for r in out] == [[("user", "q"), ("assistant", "a")]] * 4 + [[]] * 3
    assert [r.layout for r in out] == ["messages", "conversations", "prompt", "instruction_input"] + [None] * 3
    assert chat.rejects(chat.canonical(spark.createDataFrame([(r,) for r in records], "record string"))).count() == 3


def test_chat_layouts_share_a_table(spark):
    """Rows of several layouts go through different mappings; unknown ones are returned as rejects."""
    from lexloom.llm import chat

    item = "array<struct<role:string,content:string>>"
    schema = f"conv_id long, prompt string, completion string, messages {item}, turn int, role string, text string, `from` string, value string, other string"
    rows = [
        (1, "q", "a", None, None, None, None, None, None, None), (2, None, None, [("user", "q"), ("assistant", "a")], None, None, None, None, None, None),
        (3, None, None, None, 1, "assistant", "a", None, None, None), (3, None, None, None, 0, "user", "q", None, None, None),
        (4, None, None, None, 1, None, None, "gpt", "a", None), (4, None, None, None, 0, None, None, "human", "q", None), (5, None, None, None, None, None, None, None, None, "x"),
        (6, "q", None, None, None, None, None, None, None, "x"), (7, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: [(b.role, b.text) for b in r.back] for r in chat.conversations(df).withColumn("back", chat.read_back()).collect()}
    assert got == {k: [("user", "q"), ("assistant", "a")] for k in (1, 2, 3, 4)} | {7: [("", "")]}
    canon = chat.canonical_rows(df, "conv_id")
    assert {r.conv_id for r in chat.rejects(canon).collect()} == {5, 6}
    assert len({r.fingerprint for r in canon.collect()}) == 7 and {r.layout for r in canon.collect()} == {"prompt", "messages", "row", "share_row", None}


def test_chat_keeps_very_long_turns(spark):
    from pyspark.sql import functions as F

    from lexloom.llm import chat

    n = 25_000_000
    rows = spark.range(2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 0, F.repeat(F.lit("a<|b\\"), n // 5)).otherwise("ok").alias("text"))
    r = chat.conversations(rows).select(F.transform(chat.read_back(), lambda b: F.length(b["text"])).alias("n"), chat.loss_text().alias("loss"), F.length("formatted").alias("size")).first()
    assert r.n == [n, 2] and r.loss == "ok" and r["size"] == n + 2 * (n // 5) + 2 + len("<|turn|>user<|turn|>assistant") + 2 + 2 * len(chat.END)


def test_mixing(spark, docs, empty):
    from lexloom.llm import mixing

    rows = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert len(rows) == len(awkward())
    for r in rows:
        assert r["size"] == (size(r.text)) and r.taken == r["size"] * len(r.copies) and len(r.copies) <= 3
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    assert mixing.targets([("a", 10), ("b", 100), (None, 1000)])["a"] == 30.0
    again = sorted((str(r.doc_id), str(r.text), str(r.copies)) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == sorted((str(r.doc_id), str(r.text), str(r.copies)) for r in rows)
    assert mixing.mix(empty).count() == 0
    drawn = mixing.draw(mixing.mix(docs)).collect()
    assert len(drawn) == sum(len(r.copies) for r in rows)
    assert sum(r.taken for r in rows) == sum(r["size"] for r in drawn)
    # Quotas, tree and draws agree: a shard holds the blocks of a source that the tree deals it.
    for s in {r.source for r in rows}:
        own = [(r.copy["pass"], r.copy.block, r.copy.shard) for r in drawn if r.source == s]
        assert all(a[2] <= b[2] for a, b in zip(sorted(own), sorted(own)[1:]))
    # One id that repeats, and rows that agree in all columns, are split like others; names of inner columns do not clash.
    many = [(5, "a b c", "x", 1, 0, i) for i in range(900)] + [(None, "d e", "y", 2, 0, 0)] * 300 + [(i, "f", None, 3, 0, 0) for i in range(400)]
    df = spark.createDataFrame(many, "doc_id long, text string, source string, _source int, _passes int, copy int").repartition(4)
    got = mixing.mix(df).collect()
    assert len(got) == len(many) and {r["_source"] for r in got} == {1, 2, 3}
    for s in ("x", "y", None):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 and all(r.taken <= 3 * r["size"] for r in own)
    bag = lambda rs: sorted((str(r.doc_id), str(r.source), r.taken, str(r.copies)) for r in rs)
    assert bag(got) == bag(mixing.mix(df.repartition(7)).collect())
    assert mixing.MOST_DRAWN // (mixing.MOST_SOURCES * 4) >= 1
    huge = mixing.split(np.full(mixing.MOST_SOURCES, mixing.MOST_DRAWN // mixing.MOST_SOURCES), 3, np.random.default_rng(1))
    assert huge.sum() == mixing.MOST_SOURCES * (mixing.MOST_DRAWN // mixing.MOST_SOURCES)
    dealt = mixing.split(np.array([100, 50, 7]), 5, np.random.default_rng(0))
    assert (dealt.sum(0) == [100, 50, 7]).all() and np.ptp(dealt.sum(1)) <= 1


def check_shards(rows, given, shards, whole=0.02):
    """Slots gapless, sizes and sums right, bytes near equal but for one record or whole group, groups whole."""
    want = sorted((d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in given)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == want
    by, total = {}, sum(r["size"] for r in rows)
    for r in rows:
        by.setdefault(r.shard, []).append((r.slot, r["size"], r.text_crc32))
    at, largest = 0, max(r["size"] for r in rows)
    for k in sorted(by):
        assert 0 <= k < shards and sorted(s for s, *_ in by[k]) == list(range(len(by[k])))
        at += sum(s for _, s, _ in by[k])
        assert abs(at - total * (k + 1) / shards) <= largest + whole * total / shards + 1
    groups = {}
    for r in rows:
        groups.setdefault((r.text_crc32, r["size"]), []).append(r)
    for own in groups.values():
        if len(own) > 1 and sum(r["size"] for r in own) <= whole * total / shards:
            assert len({r.shard for r in own}) == 1


def test_sharding(spark, docs, empty):
    from lexloom.llm import sharding

    given = [(d, t) for d, t, *_ in awkward()] + [(None, "n"), (None, "m"), (None, None)]
    frame = docs.unionByName(spark.createDataFrame([(d, t, None, None, None, 0, 0) for d, t in given[-3:]], SCHEMA))
    for ranges in (None, 16):
        check_shards(sharding.shard(frame, 4, ranges).collect(), given, 4)
    hot = [(i % 50, "same text here" if i % 3 == 0 else f"t{i}") for i in range(3000)] + [(7, "one row again and again")] * 900
    df = spark.createDataFrame(hot, "doc_id long, text string").repartition(3)
    check_shards(sharding.shard(df, 4, 16).collect(), hot, 4)
    keys = sharding.measured(df)
    one = sharding.ranged(keys.filter("size = 24"), sharding.quantiles([tuple(r) for r in keys.select(*sharding.KEY).collect()], 40))
    assert one.select("part").distinct().count() > 5  # rows that are equal in all but their number part
    assert sharding.shard(empty).count() == 0


def test_simhash(spark, docs, empty):
    import xxhash

    from lexloom.llm import simhash

    def brute(t):
        w = t.encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for _, t, *_ in awkward():
        assert simhash.fingerprint(t or "") == [brute(t or "")]
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in base[:150]:
        for _ in range(3):
            fps.append(int(x) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 5), replace=False)))
    fps = np.unique(np.array(fps + [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)], np.uint64))
    signed = fps.view(np.int64)
    df = spark.createDataFrame([(int(x), [int(x)]) for x in signed], "class long, fp array<long>")
    for leaf in (4, 40):
        from lexloom.llm.common import components

        got = {r.id: r.component for r in components(simhash.links(df, sample=800, leaf=leaf)).collect()}
        order = np.argsort(signed)
        x, s = fps[order], signed[order]
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)
        label = simhash.forest(len(x), i, j)
        assert [got.get(int(v), int(v)) for v in s] == [int(s[k]) for k in label]
    old = simhash.PAIRS_AT_ONCE
    simhash.PAIRS_AT_ONCE = 64  # makes a leaf use its own trees
    n = len(fps)
    got = list(simhash.near(np.arange(0, n, 2), np.arange(1, n, 2), fps, 2, rng))
    simhash.PAIRS_AT_ONCE = old
    a, b = (np.concatenate([g[k] for g in got]) for k in (0, 1))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    want = {(int(p), int(q)) for p, q in zip(i, j) if p < q and not (p % 2 and q % 2)}
    assert {(min(p, q), max(p, q)) for p, q in zip(a.tolist(), b.tolist())} == want
    assert simhash.groups(empty).count() == 0
    rows = awkward() + [(None, "x y z", None, None, None, 0, 0), (None, "a", None, None, None, 0, 0)]
    out = simhash.groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    prints = np.array([brute(t or "") for _, t, *_ in rows], np.uint64)
    label = simhash.forest(len(rows), *np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2))
    least = {k: min((r[0] for r, m in zip(rows, label) if m == k and r[0] is not None), default=None) for k in set(label.tolist())}
    want = sorted((str(r[0]), int(f), str(least[k])) for r, f, k in zip(rows, prints, label.tolist()))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in out) == want


def test_vectors(spark):
    from lexloom.llm import vectors

    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 16))
    near = base[:100] + 0.05 * rng.standard_normal((100, 16))
    hot = base[:1] + 0.08 * rng.standard_normal((1500, 16))
    x = np.concatenate([base, near, hot, base[5:6], base[5:6]]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] * 16)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows) and all(got[i].n_links == 0 and got[i].kept for i in range(9000, 9004))
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = (y @ y.T >= 0.95).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_in_a_cone(spark):
    """Pairs amid a crowd of unlinked vectors, by passes and by blocks."""
    from lexloom.llm import vectors
    from lexloom.llm.common import components

    rng = np.random.default_rng(8)
    part = lambda n, m: (lambda u: u / np.linalg.norm(u, axis=1)[:, None])(rng.standard_normal((n, 64))) * np.sqrt(1 - m)
    u = part(6000, 0.9)
    w = part(200, 0.0)
    u[1::30] = 0.55 * u[::30] + np.sqrt(1 - 0.55**2) * np.sqrt(0.1) * w
    cone = u + np.sqrt(0.9) * np.eye(64)[0]
    x = np.concatenate([cone, part(6000, 0.0)]).astype(np.float32)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    i, j = np.nonzero(np.triu(y @ y.T >= 0.95, 1))
    assert 100 < len(i) < 1000
    df = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    _, _, reps = vectors.classes(df)
    name = {r["class"]: r["first"] for r in reps.select("class", "first").collect()}
    for rows in (512, 4096):
        got = {name[r.id]: r.component for r in components(vectors.passes(reps, 0.95, rows=rows)).collect()}
        found = sum(a in got and got[a] == got.get(b) for a, b in zip(i.tolist(), j.tolist()))
        assert found >= 0.99 * len(i), (rows, found, len(i))


def test_vectors_edges(spark):
    """Lengths differ, components are huge or tiny, rows repeat, columns clash: pairs against brute force."""
    from lexloom.llm import vectors

    inf = float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0, 0.0]), (3, []), (4, [1e-200, 2e-200]), (5, [1e200, 2e200]), (6, [inf, 1.0]), (7, [-inf, 1.0]), (8, [3.0]), (9, [-3.0]), (10, [5.0]), (0, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, class string, component int")
    got = {(r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()}
    alone = {(i, 0, i) for i in (2, 3, 6, 7, 9)}
    assert got == alone | {(i, 4, 0) for i in (0, 1, 4, 5)} | {(8, 1, 8), (10, 1, 8)}
    # Ids that repeat with other vectors, or are null, stay one row each.
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (2, [0.0, -1.0]), (3, [-1.0, 0.01])]
    got = [tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    want = [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (None, 2, 3, False), (None, 2, 3, False), (None, 0, None, True), (2, 0, 2, True), (3, 2, 3, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sketch(spark, docs, empty):
    from lexloom.llm import sketch

    got = sketch.compared(docs).collect()
    rows = [(r[0], r[1] or "") for r in awkward()]
    assert len(got) == len(rows)
    # Ids ascend; rows of one id stand in any order of their texts.
    by = {}
    for d, t in rows:
        by.setdefault(d, []).append(t)
    ids = sorted(by)

    def hashes(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    seen = set()
    for r in got:
        k = ids.index(r.doc_id)
        nexts = by[r.doc_id] + by[ids[(k + 1) % len(ids)]] if len(by[r.doc_id]) > 1 else by[ids[(k + 1) % len(ids)]]
        for t, nxt in ((t, nxt) for t in by[r.doc_id] for nxt in nexts):
            h = len(t) // 2
            edited = t[: len(t) - h] + nxt[:h]
            if len(t) == r.n_chars and hashlib.sha256(edited.encode()).hexdigest() == r.edited_sha256:
                break
        else:
            raise AssertionError(r.doc_id)
        pairs = [(edited, r.near_edited)] + ([(nxt, r.near_next)] if h or len(nexts) == 1 else [])  # else it is open which text of one id came next
        for other, near in pairs:
            a, b = hashes(t), hashes(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= near <= 1 and (near == 1.0 if a == b else True)
            assert len(a | b) < 500 or abs(true - near) < 0.1, (r.doc_id, true, near)
            seen.add(len(a | b) >= 500)
    assert seen == {True, False}
    assert len({(r.fingerprint) for r in got if r.n_chars == len(awkward()[6][1])}) == 1  # equal texts
    small = sketch.with_next(docs, rows_per_range=4).select("doc_id", "next_text").collect()
    assert len(small) == len(rows)
    for r in small:
        assert r.next_text in by[ids[(ids.index(r.doc_id) + 1) % len(ids)]] + (by[r.doc_id] if len(by[r.doc_id]) > 1 else [])
    tail = spark.createDataFrame([(None, "n"), (1, "a b"), (None, "m"), (2, None)], "doc_id long, text string")
    for size in (1, 1500):
        assert sorted(r.next_text for r in sketch.with_next(tail, size).collect()) == ["", "a b", "m", "n"]
    assert sketch.compared(empty).count() == 0
    f = sketch.sketched(docs.fillna("", ["text"]), "text", "s").selectExpr("doc_id % 2 as k", "s")
    want = {0: set(), 1: set()}
    for r in f.collect():
        want[r.k].update(r.s)
    few = {k: sorted(h for h in v if h < sketch.limit(0.25)) for k, v in want.items()}
    assert {r.k: r.s for r in sketch.merged(f, "k", "s").collect()} == {k: few[k] or [min(v)] for k, v in want.items()}
    blank = spark.createDataFrame([(1, " ")], "k long, text string")
    assert sketch.merged(sketch.sketched(blank, "text", "s"), "k", "s").collect()[0].s == []
    # Stand-ins above the fraction leave a union that has a hash below it, and stay the smallest where none has.
    lim = sketch.limit(0.25)
    parts = spark.createDataFrame([(1, [lim + 5]), (1, [lim - 1, lim - 9]), (2, [lim + 7]), (2, [lim + 3])], "k long, s array<long>")
    assert {r.k: r.s for r in sketch.merged(parts, "k", "s").collect()} == {1: [lim - 9, lim - 1], 2: [lim + 3]}


def test_vectors_go_through_windows_at_every_size(spark):
    """A table that has links, found by passes alone: counts of windows, and what they find, against all pairs."""
    from lexloom.llm import vectors
    from lexloom.llm.common import forest

    rng = np.random.default_rng(12)
    base = rng.standard_normal((1500, 24))
    x = np.concatenate([base, base[:900] + 0.12 * rng.standard_normal((900, 24)), base[:300] + 0.12 * rng.standard_normal((300, 24))]).astype(np.float32)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = y @ y.T >= 0.95
    label = forest(len(x), *np.nonzero(hit))
    assert (hit.sum() - len(x)) // 2 > 1000
    df = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    _, _, reps = vectors.classes(df)
    made = vectors.plan(y, len(x), 0.95, 0.002, 1024, 11)
    assert len(made) > 3 and all(len(c) == 8 for c in made)
    assert {len(vectors.plan(y[:n], n, 0.95, 0.002, 1024, 11)) > 0 for n in (1, 10, 700)} == {True}
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    right = sum(got[i] == (hit[i].sum() - 1, label[i]) for i in range(len(x)))
    assert right >= 0.995 * len(x), right


def test_all_vectors_decide_how_many_passes(spark):
    """A cone that a small sample hardly sees: the passes that it proposes miss pairs there, the table asks for more."""
    import pyarrow as pa

    from lexloom.llm import vectors

    rng = np.random.default_rng(5)
    wide, cone = rng.standard_normal((6000, 16)), rng.standard_normal(16) + 0.02 * rng.standard_normal((1500, 16))
    x = vectors.unit(pa.array([*wide.tolist(), *cone.tolist()]))
    reps = spark.createDataFrame([(i, r.tolist(), 16) for i, r in enumerate(x)], "class long, v array<double>, dim int").repartition(4)
    one = vectors.plan(x[:400], len(x), 0.95, 0.002, 128, 11)[:1]
    assert vectors.needed(reps, 16, one, 0.95, 0.002, 11) is None  # one pass is not enough
    cuts = vectors.plan(x[:400], len(x), 0.95, 0.002, 128, 11, least=60)
    base = vectors.needed(reps, 16, cuts, 0.95, 0.002, 11)
    assert base is not None and vectors.needed(reps.repartition(7), 16, cuts, 0.95, 0.002, 11) == base
    y, apart = vectors.partners(x, np.arange(len(x)), 0.95, 11), np.ones(len(x), bool)
    assert np.abs((x * y).sum(1) - 0.95).max() < 1e-9
    depth = len(cuts[0]).bit_length() - 1
    for k in range(base):
        at, to = (vectors.ranges(v, vectors.directions(11, k, 16, depth), cuts[k]) for v in (x, y))
        part = at >> max(0, depth - 5) if not k else part
        apart &= np.abs(at - to) > 1
        assert (k + 1 == base) == (np.bincount(part, apart) <= 0.002 * np.bincount(part)).all()
