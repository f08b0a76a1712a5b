"""Every registered query of the llm subpackage, with its own parameters, on one awkward set of tables and on empty ones."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from compare import difference

pytest.importorskip("lexloom.llm")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, d int, t int, gone int, row int, doc int, label string"
TABLES = {
    "documents": DOCS, "embeddings": "vec_id long, embedding array<float>, label int, class int, v int", "pages": "page_id long, url string, html string, host string, node int",
    "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string, turns int", "benchmark": "item_id long, text string",
}
OPS = {
    "op1_best_fit_packing", "op2_chat_schema_fingerprints", "op3_suffix_array_lines", "op4_source_mixing", "op5_crf_toxicity", "op6_simhash_vantage_trees",
    "op7_sampled_range_sharding", "op8_sorted_projections", "op9_site_style_trees", "op10_scaled_sketch", "op11_orchard_codes", "op12_rank_queue_bpe",
    "op13_turn_repair",
}


def documents():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdehlnorst") for _ in range(rng.randrange(2, 8)))
    passage = " ".join(word() for _ in range(55))
    texts = [None, "", " \t\n", "a", "A b", "é" * 40, "<|end|> \\ <|turn|>", "same text", "same text", "x\ny\nx\ny", " ".join(word() for _ in range(30_000))]
    texts += ["\n".join(" ".join(word() for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    for i in range(20, 60, 5):
        texts[i] += "\n" + passage
    for i in range(100, 300, 4):
        texts[i] += " vileword"
    ids = [None if i % 11 == 5 else i // 2 if i % 13 == 0 else i for i in range(len(texts))]
    rows = [(d, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, i, 1, 2, 3, 4, 5, "x") for i, (d, t) in enumerate(zip(ids, texts))]
    return rows + [rows[30]] * 3


def vectors():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 8))
    x = np.concatenate([x, x[:60] + 0.05 * rng.standard_normal((60, 8)), x[:5]]).astype(np.float32)
    rows = [(i // 2 if i % 17 == 0 else i, [float(a) for a in r], 0, 1, 2) for i, r in enumerate(x)]
    return rows + [(900, None, 0, 1, 2), (901, [], 0, 1, 2), (902, [0.0] * 8, 0, 1, 2), (903, [float("nan")] * 8, 0, 1, 2), (904, [None] * 8, 0, 1, 2), (904, [float("inf")] * 8, 0, 1, 2)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    whole, empty = tmp_path_factory.mktemp("whole"), tmp_path_factory.mktemp("empty")
    docs = documents()
    rows = {
        "documents": docs, "embeddings": vectors(), "benchmark": [(1, "x")],
        "pages": [(1, None, None, "h", 1), (1, "http://a/x", "", "h", 1), (None, "http://a/y", "<p>one<p>two &amp; three", "h", 1), (2, "no url", "<nav>menu</nav><main>text <b>bold</b></main>", "h", 1), (2, "no url", "<nav>menu</nav><main>text <b>bold</b></main>", "h", 1)],
        "labels": [(r[0], 1, int("vileword" in (r[1] or ""))) for r in docs if r[0] is not None] + [(None, None, None), (3, None, None)],
        "conversations": [(i // 3, i % 3 if i % 7 else None, ("user", "assistant", "a\nb", None)[i % 4], docs[i % 40][1], 1) for i in range(90)] + [(4, 0, "user", "again", 1)] * 2,
    }
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).repartition(3).write.parquet(f"{whole}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return str(whole), str(empty)


def run(spark, name, folder):
    from lexloom.llm.queries import QUERIES

    return QUERIES[name](spark, folder).collect()


def test_all_are_registered_and_pass_empty_tables(spark, tables):
    from lexloom.llm.queries import QUERIES

    assert set(QUERIES) == OPS
    for name in OPS:
        assert len(run(spark, name, tables[1])) == (name.startswith("op2_")), name  # op2 adds a conversation of its own


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def ids_of(rows):
    return sorted(str(r[0]) for r in rows)


def test_op1(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = run(spark, "op1_best_fit_packing", tables[0])
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t, *_ in documents():
        ids = full.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, stop in enumerate(range(first, len(ids) + 1, 1024)):
            start = max(0, stop - 1024) if k else 0
            want.append((str(d), k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024


def test_op2(spark, tables):
    from lexloom.llm.queries import ORACLE, QUERIES

    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tables[0]}/conversations.parquet/*.parquet'")
    name = "op2_chat_schema_fingerprints"
    assert difference(spark, con, QUERIES[name], ORACLE[name], tables[0]) == ""


def test_op3(spark, tables):
    got = run(spark, "op3_suffix_array_lines", tables[0])
    assert ids_of(got) == ids_of(documents())
    # One passage of 55 words repeats; the first holder by id keeps it, rows that agree are one document.
    texts = {}
    for d, t, *_ in documents():
        texts.setdefault((d if d is not None else -1, t), 0)
    passage = max((x for _, t in texts if t for x in t.split("\n") if 50 <= n_words(x) < 100), key=lambda x: sum(x in t.split("\n") for _, t in texts if t))
    holders = sorted((k for k in texts if k[1] and passage in k[1].split("\n")), key=lambda k: k[0])
    assert len(holders) > 4 and sum(passage in (r.text or "").split("\n") for r in got) == 1
    for r in got:
        assert (r.text is None) == (r.n_lines == 0) and r.n_removed in (0, 1)


def test_op4(spark, tables):
    from lexloom.llm import mixing

    got = run(spark, "op4_source_mixing", tables[0])
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(d), n_words(t)) for d, t, *_ in documents())
    sizes = {}
    for _, t, _, s, *_ in documents():
        sizes[s] = sizes.get(s, 0) + n_words(t)
    goal = mixing.targets(list(sizes.items()))
    by = {}
    for r in got:
        assert r.taken <= 3 * r["size"] and r.taken == r["size"] * len(r.shards)
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sorted(by) == sorted((sizes[s], goal[s]) for s in sizes)
    assert all(abs(sum(v) - target) <= 30_000 * (size > 30_000) + 120 for (size, target), v in by.items())
    again = run(spark, "op4_source_mixing", tables[0])
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_op5(spark, tables):
    got = run(spark, "op5_crf_toxicity", tables[0])
    assert ids_of(got) == ids_of(documents())
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) or r.doc_id is None
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    bad = {str(d) for d, t, *_ in documents() if t and "vileword" in t}
    assert sum(r.predicted == (str(r.doc_id) in bad) for r in got if r.doc_id is not None) >= 0.95 * len([r for r in got if r.doc_id is not None])


def test_op6(spark, tables):
    import xxhash

    from lexloom.llm.common import forest

    rows = documents()

    def brute(t):
        w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))]
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in sh], np.uint64)
        return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))

    fps = np.array([brute(r[1]) for r in rows], np.uint64)
    label = forest(len(rows), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)).tolist()
    least = {k: min((r[0] for r, m in zip(rows, label) if m == k and r[0] is not None), default=None) for k in set(label)}
    want = sorted((str(r[0]), f"{int(f):016x}", str(least[k])) for r, f, k in zip(rows, fps, label))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in run(spark, "op6_simhash_vantage_trees", tables[0])) == want


def test_op7(spark, tables):
    from test_operators import check_shards

    got = run(spark, "op7_sampled_range_sharding", tables[0])
    check_shards(got, [(d, t) for d, t, *_ in documents()], 8)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_op8(spark, tables):
    from lexloom.llm.common import forest

    rows = vectors()
    ok = [i for i, r in enumerate(rows) if r[1] and all(a is not None and np.isfinite(a) for a in r[1]) and any(r[1])]
    x = np.array([rows[i][1] for i in ok])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.95
    label = forest(len(ok), *np.nonzero(hit)).tolist()
    want = [(r[0], 0, r[0]) for i, r in enumerate(rows) if i not in set(ok)]
    want += [(rows[i][0], int(hit[k].sum()) - 1, min(rows[j][0] for j, m in zip(ok, label) if m == label[k])) for k, i in enumerate(ok)]
    got = run(spark, "op8_sorted_projections", tables[0])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_op9(spark, tables):
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in run(spark, "op9_site_style_trees", tables[0]))
    assert got == sorted([("1", "None", "", 0), ("1", "http://a/x", "", 0), ("None", "http://a/y", "one\ntwo & three", 15), ("2", "no url", "text bold", 9), ("2", "no url", "text bold", 9)])


def test_op10(spark, tables):
    rows = documents()
    got = run(spark, "op10_scaled_sketch", tables[0])
    by, prints = {}, {}
    for d, t, *_ in rows:
        by.setdefault(-1 if d is None else d, []).append(t or "")
    ids = sorted(by)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(d), len(t or "")) for d, t, *_ in rows)
    for r in got:
        d = -1 if r.doc_id is None else r.doc_id
        nexts = by[ids[(ids.index(d) + 1) % len(ids)]] + (by[d] if len(by[d]) > 1 else [])
        fits = [(t, n, t[: len(t) - len(t) // 2] + n[: len(t) // 2]) for t in by[d] if len(t) == r.n_chars for n in nexts]
        fits = [f for f in fits if hashlib.sha256(f[2].encode()).hexdigest() == r.edited_sha256]
        assert fits, r.doc_id
        t, n, edited = fits[0]
        prints.setdefault(t, set()).add(r.fingerprint)
        for other, near in ((edited, r.near_edited), *([(n, r.near_next)] if len({f[1] for f in fits}) == 1 else [])):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= near <= 1 and (a != b or near == 1.0) and (len(a | b) < 500 or abs(near - true) < 0.1)
    assert all(len(v) == 1 for v in prints.values())
