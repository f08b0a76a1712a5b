"""Vector codes, byte-level BPE and conversation repair against plain second versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("lexloom.llm")

from test_queries import documents, run, tables, vectors  # noqa: E402, F401


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, digest) of rows (vec_id, vector, label), one by one."""
    out = []
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(a is not None and np.isfinite(a) for a in v)]
    for dim in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        size = [dim // parts + (k < dim % parts) for k in range(parts)]
        cut = [sum(size[:k]) for k in range(parts + 1)]
        q = [[int(np.floor(float(np.float32(a)) * 4096)) if abs(a) < 1e30 else int(float(np.float32(a))) * 4096 for a in v] for _, v, _ in own]
        x = [[r[cut[k] : cut[k + 1]] for k in range(parts)] for r in q]
        books = [[r[k] for r in x[:entries]] for k in range(parts)]
        near = lambda k, y: min((sum((a - b) ** 2 for a, b in zip(y, c)), e) for e, c in enumerate(books[k]))  # noqa: E731, B023
        for _ in range(rounds):
            for k in range(parts):
                at = [near(k, r[k])[1] for r in x]
                books[k] = [[sum(c) // len(c) for c in zip(*mine)] if (mine := [r[k] for r, a in zip(x, at) if a == e]) else old for e, old in enumerate(books[k])]
        digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for (i, _, label), r in zip(own, x):
            found = [near(k, r[k]) for k in range(parts)]
            out.append((i, "".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), 2**63 - 1), label, digest))
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((i, c, d, min(total[label], 2**63 - 1), s) for i, c, d, label, s in out), key=str)


def test_op11(spark, tables):  # noqa: F811
    got = run(spark, "op11_orchard_codes", tables[0])
    want = plain_codes([(r[0], r[1], r[2]) for r in vectors()])
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str) == want
    assert len(got) < len(vectors())


def test_codes_of_odd_lengths_large_values_ties_and_null_labels(spark):
    from lexloom.llm import codes

    rng = random.Random(4)
    rows = [(i if i % 9 else None, [rng.choice([-1.5, 0.0, 0.25, 2.0]) for _ in range(11)], (None, "", "a")[i % 3]) for i in range(80)] + [(5, [0.5] * 11, "a")] * 3
    rows += [(200 + i, [rng.choice([1e30, -3.0, 1e6]) for _ in range(3)], "b") for i in range(20)] + [(300, [1.0], "c"), (301, [], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(5).withColumn("code", codes.F.lit(1)).withColumn("dim", codes.F.lit(2))
    got = codes.compressed(df).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str) == plain_codes(rows)
    assert codes.compressed(df.filter("false")).count() == 0


def test_orchard_search_is_exact_and_looks_at_few(spark):
    from lexloom.llm import codes

    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (3000, 4))
    entries = x[:64].copy()
    entries[7] = entries[3]
    d = ((x[:, None] - entries[None]) ** 2).sum(-1)
    at, best = codes.Orchard(entries).search(x)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def test_codes_decode(spark):
    from lexloom.llm import codes

    rng = np.random.default_rng(5)
    rows = [(i, [float(a) for a in rng.choice(3, 16)], None) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = codes.train(df)
    back = codes.decode(codes.encode(df, books, ["vec_id", "embedding"]), books)
    assert all(abs(sum((a - b) ** 2 for a, b in zip(r.embedding, r.approximation)) * 4096**2 - r.error) < 1 for r in back.collect())


@pytest.fixture(scope="module")
def library():
    import base64

    import public_tokenizers as P
    import tiktoken

    from lexloom.llm import tokens

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tokens.Bpe(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op12(spark, tables, library):  # noqa: F811
    _, enc = library
    want = []
    for d, t, *_ in documents():
        ids = enc.encode_ordinary(t or "")
        want.append((str(d), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = run(spark, "op12_rank_queue_bpe", tables[0])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_bpe_equals_the_library(library):
    own, enc = library
    rng = random.Random(1)
    texts = ["", "\x1c\x85 　", "<|endoftext|>", "՘࢏꟎ x", "aaaa" * 700, "ab" * 999, "the" * 400 + "\n" * 300, " " * 1000, "é" * 500, "漢字" * 300]
    texts += ["".join(rng.choice("ab \n1é漢.,'sST՘\x1c😀\U0001f1e7") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdehlnorst") for _ in range(n)) for n in (200, 255, 256, 257, 9000)]
    for t in texts:
        assert own.encode([t])[0].tolist() == enc.encode_ordinary(t), t[:50]
        assert own.decode(own.encode([t])[0]) == t.encode()
    assert not own.buckets and not any(own.leaf) and not any(own.inner)  # the queue is empty between texts
    assert own.decode(np.array([0, 10**6, -1])) == next(b for b, i in own.ranks.items() if i == 0)


def test_characters_are_classed_as_the_library_does():
    import public_tokenizers as P
    import regex
    import tiktoken

    from lexloom.llm import tokens

    strange, _ = tokens.own_classes(P.PATTERN)
    single = {bytes([i]): i for i in range(256)}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        theirs, here = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={}), regex.compile(name)
        wrong = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in strange and bool(here.match(chr(c))) != bool(theirs.encode_ordinary(chr(c)))]
        assert not wrong


def test_merges_of_a_vocabulary_whose_ranks_do_not_grow(tmp_path):
    """A longer token may have a lower rank than its parts: the queue has to come back to what waits."""
    import base64

    import tiktoken

    from lexloom.llm import tokens

    words = [bytes([i]) for i in range(256)] + [b"aba", b"bab", b"ab", b"ba", b"aa", b"abab", b"baa", b"aab", b"aaa"]
    for order in range(20):
        more = words[256:]
        random.Random(order).shuffle(more)
        all_ = words[:256] + more
        path = tmp_path / f"{order}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(w) + b" %d\n" % i for i, w in enumerate(all_)))
        own = tokens.Bpe(str(path), r"[\s\S]+")
        enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks={w: i for i, w in enumerate(all_)}, special_tokens={})
        rng = random.Random(order)
        for n in [*range(1, 60), 300, 2000]:
            t = "".join(rng.choice("aab") for _ in range(n))
            assert own.encode([t])[0].tolist() == enc.encode_ordinary(t)


STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_repair(rows):
    """(cost, audit, text) by looking at every edit, from the last row back, insertions among them."""
    from functools import lru_cache

    @lru_cache(None)
    def best(i, s, room):
        """Least (cost, audit) of what is left; ``room``: how many rows may be inserted before the next."""
        found = [(0, "", "")] if i == len(rows) and s in (0, 3) else []
        if room:
            for ini, then in STEP[s].items():
                if ini != "s" and (got := best(i, then, room - 1)):
                    found.append((5 + got[0], "I" + got[1], f"\n{dict(u='user', a='assistant')[ini]}:" + got[2]))
        if i < len(rows):
            role, text, fault = rows[i]
            if got := best(i + 1, s, 3):
                found.append((2 + got[0], "D" + got[1], got[2]))
            for ini, then in STEP[s].items() if fault not in (1, 2) else ():
                got = best(i + 1, then, 3)
                for letter, cost, name in (("K", 0, role), ("R", 1, {"u": "user", "a": "assistant"}.get(ini))):
                    if got and name is not None and (letter == "R" and name != role or letter == "K" and role[:1] == ini):
                        found.append((cost + 5 * (fault == 3) + got[0], letter + got[1], f"\n{name}:{text}" + got[2]))
        return min(found) if found else None

    cost, audit, text = best(0, 0, 3)
    return cost, audit, hashlib.sha256(text[1:].encode()).hexdigest()


def plain_conversations(table):
    out, rows = {}, {}
    for c, turn, role, text in table:
        out.setdefault(c, [])
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out[c] += [(turn is not None, turn or 0, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    for c, own in out.items():
        own.sort()
        seen, kept, n = set(), [], [0, 0, 0, 0]
        for _, _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = 1 if not last else 2 if (role, text) in seen else 3 if last[0] not in ".!?" else 0
            seen.add((role, text))
            n[fault] += 1
            kept.append((role, text, fault))
        turns = [t for known, t, *_ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        rows[c] = (gaps, *n[1:], illegal, *plain_repair(tuple(kept)))
    return rows


def seen(got):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_op13(spark, tables):  # noqa: F811
    rows = [tuple(r) for r in spark.read.parquet(f"{tables[0]}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = run(spark, "op13_turn_repair", tables[0])
    assert seen(got) == plain_conversations(rows) and len(got) == len({r[0] for r in rows})


@pytest.mark.parametrize("block", [1024, 5])
def test_repair_of_many_conversations(spark, block, monkeypatch):
    """Long ones too, block by block: tasks run in worker processes, so the smaller block is tried on the class itself."""
    from lexloom.llm import repair

    rng = random.Random(block)
    said = ["", " \n", "yes.", "no!", "what", "so?  ", "é", "\x1c"]
    table = []
    for c in range(300):
        for turn in range(rng.randrange(1, 40 if c % 10 == 0 else 9)):
            table.append((None if c == 7 else c, None if rng.random() < 0.05 else turn // rng.choice([1, 1, 1, 2]), rng.choice(["user", "assistant", "system", "user", "assistant", "", None, "x"]), rng.choice([*said, f"t{turn}.", None])))
    want = plain_conversations(table)
    if block == 1024:
        df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(6).withColumn("fault", repair.F.lit(1)).withColumn("gone", repair.F.lit(True))
        assert seen(repair.repair(repair.damaged(df)).collect()) == want
        return
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    faulty = repair.faults(repair.damaged(spark.createDataFrame(table, "conv_id long, turn long, role string, text string"))).toPandas()
    faulty = faulty.sort_values(["turn", "role", "text"], na_position="first", kind="stable")
    got = {}
    for c, own in faulty.groupby("conv_id", dropna=False):
        x = repair.Conversation(None if c != c else int(c))
        for turn, role, text, gone, fault in zip(own["turn"], own["role"], own["text"], own["gone"], own["fault"]):
            if not gone:
                x.add(None if turn != turn else int(turn), repair.Row(role, text, fault))
        r = x.result()
        got[r[0]] = r[1:9]
    assert got == want


def test_insertions_are_looked_at_where_they_could_pay():
    from lexloom.llm import repair

    row = lambda role: repair.Row(role, "x.", 0)
    assert repair.cheapest([row("user")], 0, 1)[3] == (5, "KI") and repair.cheapest([row("user")], 0, 1)[0] == (2, "D")
    assert repair.cheapest([], 0, 2)[3] == (10, "II")
    assert repair.cheapest([row("assistant"), row("assistant")], 0, 1)[3] == (1, "RK")
