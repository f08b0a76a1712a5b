"""Line deduplication, toxicity and html on small inputs, awkward rows included."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("lexloom.llm")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, score double"


def n_words(s):
    return len(re.findall(r"[^\x20\x09-\x0D]+", s))


def brute_lines(rows, least):
    rows = sorted(rows)
    out = {}
    for d, (i, t) in enumerate(rows):
        own, gone = t.split("\n"), set()
        for a in range(len(own)):
            best = 0
            for e in range(d + 1):
                other = rows[e][1].split("\n")
                for b in range(len(other) if e < d else a):
                    n = 0
                    while a + n < len(own) and b + n < len(other) and own[a + n].strip(" ") == other[b + n].strip(" "):
                        n += 1
                    best = max(best, n)
            if best and sum(map(n_words, own[a : a + best])) >= least:
                gone.update(range(a, a + best))
        out[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    return out


def test_lines_equal_brute_force(spark):
    from lexloom.llm import lines

    rng = random.Random(9)
    pool = ["", "a b", "c d e", "f", " a b ", "g h i j k", "l m n", "one two three four"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.85 else f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, None, None, None, 0, 0.0) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: r.text for r in lines.deduplicate(df, 6).collect()}
    assert got == brute_lines(rows, 6)


def test_intervals_equal_those_of_a_suffix_array(spark):
    """Runs named by pairs of ranks share an interval as in a sorted suffix array with its longest common prefixes."""
    from lexloom.llm import lines

    rng = random.Random(12)
    pool = ["a b", "c d e", "f", "g h i j k", "l m n", "one two three four"]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.9 else f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 25)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    x = lines.keep(lines.islands(df, 6))
    runs = lines.intervals(x, 6).collect()
    by = {}
    for r in x.collect():
        by.setdefault((r.d, r.island), {})[r.ln] = r.id
    suffixes = []
    for (d, _), own in by.items():
        suffixes += [(tuple(own[k] for k in range(b, max(own) + 1)), (d, b)) for b in own]
    suffixes.sort()
    place = {s[1]: i for i, s in enumerate(suffixes)}
    common = [0] * len(suffixes)
    for i in range(1, len(suffixes)):
        for p, q in zip(suffixes[i - 1][0], suffixes[i][0]):
            if p != q:
                break
            common[i] += 1

    def interval(d, b, m):
        lo = hi = place[d, b]
        while lo and common[lo] >= m:
            lo -= 1
        while hi + 1 < len(suffixes) and common[hi + 1] >= m:
            hi += 1
        return lo, hi

    named, found = {}, {}
    for r in runs:
        name = (r.m, r.i1, r.p1, r.i2, r.p2)
        assert named.setdefault(name, (r.m, *interval(r.d, r.b, r.m))) == (r.m, *interval(r.d, r.b, r.m))
        found.setdefault((r.m, *interval(r.d, r.b, r.m)), set()).add(name)
    assert len(runs) > 200 and all(len(v) == 1 for v in found.values()) and max(r.m for r in runs) >= 4


def test_lines_with_hashes_that_collide(spark, monkeypatch):
    from lexloom.llm import lines

    rng = random.Random(10)
    rows = [(i, "\n".join(rng.choice(["a b", "c d e", "f", "g h i j k", "l m n"]) for _ in range(rng.randrange(1, 9)))) for i in range(30)]
    monkeypatch.setattr(lines, "line_id", lambda line: lines.F.pmod(lines.F.length(line), lines.F.lit(3)).cast("long"))
    got = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()}
    assert got == brute_lines(rows, 6)


def test_lines_edges(spark):
    from lexloom.llm import lines

    long = " ".join(["w"] * 60)
    rows = [(1, None), (2, ""), (3, long), (4, long), (5, "x\n" + long), (5, "x\n" + long), (None, "n")]
    inner = ["t", "d", "gone", "_t", "_d", "doc", "ln"]  # names that the operator uses itself
    df = spark.createDataFrame([(i, t, None, None, None, 0, 0.0, *range(7)) for i, t in rows], SCHEMA + "".join(f", {c} int" for c in inner))
    out = lines.deduplicate(df)
    assert [c for c in df.columns if c not in ("n_lines", "n_removed")] == out.columns[:-2]
    assert {tuple(r[c] for c in inner) for r in out.collect()} == {tuple(range(7))}
    got = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str)
    assert got == sorted([(0, "n"), (1, None), (2, ""), (3, long), (4, ""), (5, "x"), (5, "x")], key=str)
    assert lines.deduplicate(df, keep_empty=False).filter("doc_id = 4").count() == 0
    assert lines.deduplicate(df.limit(0)).count() == 0
    ranked = lines.suffix_ranks(lines.islands(df, 1), 4)
    assert lines.suffix_array(ranked).count() == ranked.count()


def test_marginals_equal_enumeration():
    import itertools

    from lexloom.llm import toxicity

    rng = np.random.default_rng(2)
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    sizes = [1, 5, 3, 8, 2] * 9  # more tokens than one column holds
    emit = rng.normal(size=sum(sizes)) * 2
    first = np.zeros(len(emit), bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    got, at = toxicity.marginals(emit, first, trans, start), 0
    for n in sizes:
        mass, on = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(start[y[0]] + sum(e for e, v in zip(emit[at : at + n], y) if v) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            mass, on = mass + w, on + w * np.array(y)
        assert np.allclose(got[at : at + n], on / mass)
        at += n


def test_gradient_equals_differences():
    """Emissions, transitions and start: the gradient against differences of the log-likelihood by enumeration."""
    import itertools

    from lexloom.llm import toxicity

    rng = np.random.default_rng(4)
    sizes = [8, 1, 5, 6]
    n = sum(sizes)
    first = np.zeros(n, bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    emit, trans, start, y = rng.normal(size=n) * 2, rng.normal(size=(2, 2)), rng.normal(size=2), rng.integers(0, 2, n).astype(float)

    def likelihood(emit, trans, start):
        total, at = 0.0, 0
        weight = lambda e, s: start[s[0]] + sum(a for a, v in zip(e, s) if v) + sum(trans[a, b] for a, b in zip(s, s[1:]))
        for k in sizes:
            e = emit[at : at + k]
            total += weight(e, y[at : at + k].astype(int)) - np.log(sum(np.exp(weight(e, s)) for s in itertools.product((0, 1), repeat=k)))
            at += k
        return total

    got = toxicity.gradient(y, emit, first, trans, start)
    given, small = [emit, trans, start], 1e-5
    for which, g in enumerate(got):
        for i in np.ndindex(g.shape):
            both = []
            for sign in (1, -1):
                moved = [v.copy() for v in given]
                moved[which][i] += sign * small
                both.append(likelihood(*moved))
            assert abs((both[0] - both[1]) / (2 * small) - g[i]) < 1e-5, (which, i)


def test_toxicity(spark):
    from lexloom.llm import toxicity

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdehlnorst") for _ in range(rng.randrange(2, 8)))
    rows, marks = [], []
    for i in range(600):
        w, bad = [word() for _ in range(rng.randrange(5, 60))], i % 6 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vileword", "nastyness", "grossly" + word()])
        rows.append((i, " ".join(w), None, None, None, 0, 0.0))
        marks.append((i, 1, int(bad)))
    rows += [(1000, None, None, None, None, 0, 0.0), (1001, "", None, None, None, 0, 0.0), (1002, "? !", None, None, None, 0, 0.0)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    import zlib

    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i].score >= 0.5) == (i % 6 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score < 0.5
    wide = spark.createDataFrame([(1, "\u0130\u0130 vileword \u0130", None, None, None, 0, 0.0)], SCHEMA)  # lower-casing lengthens these letters
    (r,) = toxicity.score(wide, model, ["doc_id", "text"]).collect()
    assert [r.text[s.start : s.end] for s in r.spans] == ["vileword"]
    spans = [rows[i][1][s.start : s.end] for i in range(0, 600, 6) for s in got[i].spans]
    assert spans and all(s.startswith(("vile", "nast", "gross")) for s in spans)
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_rare_wordings_are_learned(spark):
    """A wording of one toxic document in forty becomes a cue."""
    from lexloom.llm import toxicity

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdehlnorst") for _ in range(rng.randrange(3, 8)))
    rows, marks = [], []
    for i in range(3000):
        w, bad = [word() for _ in range(12)], i % 2 == 0
        if bad:
            w[rng.randrange(12)] = "zzrarely" if i % 80 == 0 else "vileword"
        rows.append((i, " ".join(w), None, None, None, 0, 0.0))
        marks.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()
    found = [any(rows[r.doc_id][1][s.start : s.end] == "zzrarely" for s in r.spans) for r in got if r.doc_id % 80 == 0]
    assert sum(found) >= 0.9 * len(found)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Main &amp; title</h1></header><p>First  <b>bold</b>
text<p>Second &#233;<br>line <!-- hidden --></article><div id="comments"><p>Nice post</p></div><form>Mail</form><footer>&copy; x</footer>"""


def test_html(spark):
    from lexloom.llm import html

    rows = [(1, "http://A.example.com/x", PAGE), (2, None, None), (3, "u", ""), (4, "http://b", "plain text"), (5, "http://b", "<p>cut <b"), (1, "http://A.example.com/x", PAGE)]
    same = [(100 + i, "http://shop.example.org/" + str(i), f"<body><div class=t>Same words everywhere</div><div class=c>Own words {i} here</div></body>") for i in range(40)]
    df = spark.createDataFrame([(*r, 7) for r in rows + same], "page_id long, url string, html string, host int")
    out = html.extract(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) + 40
    assert got[1] == "Main & title\nFirst bold text\nSecond é\nline"
    assert got[2] == got[3] == "" and got[4] == "plain text" and got[5] == "cut"
    assert got[107] == "Own words 7 here"  # what repeats on a host goes
    assert {r.page_id: r.n_by_tree for r in out}[107] == 1
    low = html.keep(html.unimportant(html.importance(html.nodes(df.select("page_id", "url", html.host_of(df.url).alias("host"), "html").fillna("", ["html"])))))
    x = df.select("page_id", html.host_of(df.url).alias("host"), "html")
    for most in (1 << 20, 0):
        assert html.with_dropped(x, low, most).filter("texts is not null").count() == 40
    assert html.extract(df.limit(0)).count() == 0


def test_html_copies_keep_their_text(spark):
    """Copies of pages and articles, repeated values on a page and repeated text above other text cost no content."""
    from lexloom.llm import html

    def article(i, side=""):
        return f"<body>{side}<article>Shown everywhere<h1>Title {i}</h1>" + "".join(f"<p>Paragraph {k} of {i}</p>" for k in range(5)) + "</article></body>"

    pages = [("copies", article(0)) for _ in range(180)] + [("copies", article(i)) for i in range(1, 21)]
    pages += [("near", article(0, f"<div class=t>Seen {i} times</div>")) for i in range(180)] + [("near", article(i)) for i in range(1, 21)]
    pages += [("cells", "<table>" + "".join(f"<tr><td>{'yes' if i % 3 else 'no'}</td></tr>" for i in range(40)) + "</table>")]
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    for i, (host, page) in enumerate(pages):
        want = [t for _, _, main, _, t, _ in html.blocks(page) if host == "cells" or (main and t != "Shown everywhere")]
        assert got[i] == "\n".join(want), (host, i)


def neutral_host():
    """Pages whose boilerplate bears neutral names: a list of links, a branch of fixed words with a date, sections that vary."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdehlnorst") for _ in range(rng.randrange(3, 8)))
    pages, texts = [], []
    for i in range(30):
        body = [" ".join(word() for _ in range(rng.randrange(8, 20))) for _ in range(rng.randrange(2, 7))]
        links = "".join(f"<div><a href=/{word()}>{word()} {word()}</a></div>" for _ in range(4))
        low = f"<section class=z><div>Our company and its many offices</div><div>All rights are ours, always</div><p>day {i}</p></section>"
        pages.append(f"<html><body><div class=x>{links}</div><div class=y><h2>{word()} {i}</h2>" + "".join(f"<p>{t}</p>" for t in body) + f"</div>{low}</body></html>")
        texts.append(body)
    return pages, texts


def test_html_the_tree_decides(spark):
    """Boilerplate without telling names goes, text of an unmarked article stays; importance as counted by hand."""
    from collections import Counter

    from lexloom.llm import html

    pages, texts = neutral_host()
    df = spark.createDataFrame([(i, f"http://n.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    out = {r.page_id: r for r in html.extract(df).collect()}
    for i, body in enumerate(texts):
        got = out[i].text.split("\n")
        assert got[1:] == body and got[0].endswith(f" {i}") and out[i].n_by_tree == 7
    few = {r.page_id: r.text for r in html.extract(df.filter(f"page_id < {html.LEAST_PAGES - 1}")).collect()}
    assert all("Our company" in t for t in few.values())  # too few pages to tell, no names to go by
    # Entropies and blends by brute force.
    own, shapes, up, chars, linked = {}, {}, {}, Counter(), Counter()
    for p in pages:
        seen, by = {}, {}
        for node, _, _, _, t, k in html.blocks(p, seen=seen):
            by.setdefault(node, []).append(t)
            chars[node] += len(t)
            linked[node] += min(k, len(t))
        for node, (above, *_, what) in seen.items():
            up[node] = above
            if what:
                shapes.setdefault(node, []).append(tuple(what))
        for node, ts in by.items():
            own.setdefault(node, []).append(tuple(ts))

    def spread(values):
        n = len(values)
        return 1.0 if n < 2 else -sum(k / n * np.log(k / n) for k in Counter(values).values()) / np.log(n)

    content = {v: spread(ts) * (1 - linked[v] / chars[v]) for v, ts in own.items()}
    shape = {v: spread(ts) for v, ts in shapes.items()}
    x = df.select("page_id", "url", html.host_of(df.url).alias("host"), "html")
    rows = {r.node: r for r in html.importance(html.nodes(x)).collect()}
    assert set(rows) == set(up) | {0}  # the root above all pages
    for v, r in ((v, rows[v]) for v in up):
        below = [(m, up[m].index(v)) for m in up if v in up[m]]
        text = sum(chars[m] * content.get(m, 0) for m, _ in below) / max(1, sum(chars[m] for m, _ in below))
        inner = [(html.DECAY**d * len(shapes[m]), shape[m]) for m, d in below if m in shape]
        branch = html.CONTENT * text + (1 - html.CONTENT) * sum(w * s for w, s in inner) / sum(w for w, _ in inner) if inner else text
        assert abs(r.branch - branch) < 1e-9 and (r.content is None) == (v not in content) and abs((r.content or 0) - content.get(v, 0)) < 1e-9


def test_html_awkward_pages_take_linear_time():
    import time
    import tracemalloc

    from lexloom.llm import html

    deep = "<div class=abc>" * 50_000 + "deep text"
    quotes = "<p a='x" + "<b>word " * 50_000
    scripts = "<textarea>" * 20_000 + "</p>" * 20_000
    for page in (deep, quotes, scripts, "<p>" * 100_000, "<" * 200_000, "</div>" * 100_000):
        tracemalloc.start()
        began = time.time()
        got = html.blocks(page, seen={})
        assert time.time() - began < 20 and tracemalloc.get_traced_memory()[1] < 200e6
        tracemalloc.stop()
        assert page is not deep or [b[4] for b in got] == ["deep text"]
        assert page is not quotes or len(got) == 1


def near_copies(spark):
    """Documents of random words, some with a few words changed, and how alike their five-word shingles are."""
    rng = random.Random(21)
    texts = []
    for _ in range(120):
        w = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts.append(" ".join(w))
        for _ in range(2):
            v = list(w)
            for _ in range(3):
                v[rng.randrange(300)] = "changed"
            texts.append(" ".join(v))
    return texts


def test_survivors(spark):
    """One row of a group stays, whatever ids are null or repeat; unlike texts stay all."""
    from lexloom.llm import simhash

    texts = near_copies(spark)
    rows = [(None if i % 7 == 0 else i // 2, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(5, texts[0], "en", "s", 1), (5, texts[0], "en", "s", 1), (900, None, None, None, None), (901, "", None, None, 0), (None, "one of its kind", None, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    for held in (25_000, 60):
        got = simhash.survivors(df, least_held=held).collect()
        group = lambda t: texts.index(t) // 3 if t in texts else t or ""
        seen = [group(r.text) for r in got]
        assert len(set(seen)) == 122 and len(seen) <= 122 * 1.03, (held, len(seen))
        for r in got:
            alike = [x for x in rows if group(x[1]) == group(r.text)]
            if len([1 for g in seen if g == group(r.text)]) == 1:
                assert (r.doc_id if r.doc_id is not None else 10**9) == min(x[0] if x[0] is not None else 10**9 for x in alike)
    assert simhash.survivors(df.limit(0)).count() == 0


def test_pipeline(spark):
    cp = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in cp.drop_toxic(spark, docs, sf).collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    assert docs.count() - len(kept) <= 3 * len(bad) + 5
    for name, stage in cp.STAGES[1:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() > 0
    assert cp.run(spark, sf).count() > 0


def test_pipeline_stages_keep_rows_of_any_id(spark):
    """Null, repeated and clashing rows survive each stage that does not remove them by its own rule; empty tables pass."""
    cp = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    rng = random.Random(5)
    rows = [(None if i % 4 == 0 else i % 9, " ".join(f"w{rng.randrange(9999)}" for _ in range(30)), "en", f"s{i % 2}", i) for i in range(60)]
    rows += [(1, None, None, None, None), (None, "", "en", "s0", 0), rows[5]]
    extra = "size int, score int, doc int, key int, fp int, component int, copy int, copies int, gone int, row int, t int"
    df = spark.createDataFrame([(*r, *range(11)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra).repartition(3)
    bag = lambda rs: sorted((str(r[0]), str(r[1]), str(r[3])) for r in rs)
    assert bag(cp.drop_toxic(spark, df, sf).collect()) == bag(rows)
    # Copies of each other: the repeated row; the null and the empty text.
    assert bag(cp.drop_repeated_lines(spark, df, sf).collect()) == bag([r for r in rows])
    assert bag(cp.drop_near_copies(spark, df, sf).collect()) == bag(rows[:60] + [rows[60]])
    mixed = cp.mix_sources(spark, df, sf).collect()
    words = lambda rs: sum(n_words(r[1] or "") for r in rs)
    assert abs(words(mixed) - words(rows)) <= 60 and {str(r.doc_id) for r in mixed} >= {"None"}
    assert cp.pack(spark, df, sf).count() == len(rows)
    for _, stage in cp.STAGES:
        assert stage(spark, df.limit(0), sf).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """Cases planted in a small table: toxic documents, a repeated passage and near copies go, the rest is packed whole."""
    cp = pytest.importorskip("corpus_pipeline")
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdehlnorst") for _ in range(rng.randrange(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, marks = [], []
    for i in range(700):
        text = "\n".join(line(20) for _ in range(4))
        if i % 7 == 0:
            w = text.split(" ")
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vileword", "nastyness"])
            text = " ".join(w)
        rows.append([i, text, "en", f"s{i % 3}", len(text)])
        marks.append((i, 1, int(i % 7 == 0)))
    passage = line(60)
    for i in (11, 12, 13):
        rows[i][1] += "\n" + passage
    rows[201][1], rows[300][1] = rows[200][1], rows[299][1].replace("\n", " x ", 1)
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in cp.STAGES[:3]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r.doc_id: r.text for r in docs.collect()})
    clean = {r[0]: r[1] for r in rows if r[0] % 7}
    assert left[0] == clean
    lined = {i: "\n".join(x for x in t.split("\n") if x != passage or i == 11) if i != 201 else "" for i, t in clean.items()}
    assert left[1] == {i: t for i, t in lined.items() if t} and passage in left[1][11]
    assert left[2] == {i: t for i, t in left[1].items() if i != 300}
    packed = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} <= set(left[2])
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 1024 and sorted(v)[0][0] == 0 for v in by.values())
    size = {i: n_words(t) for i, t in left[2].items()}
    target = {s: sum(size[i] for i in size if f"s{i % 3}" == s) for s in ("s0", "s1", "s2")}
    taken = {s: sum(size[r.doc_id] for r in packed if r.piece == 0 and f"s{r.doc_id % 3}" == s) for s in target}
    from lexloom.llm import mixing

    for s, want in mixing.targets(list(target.items())).items():
        assert abs(taken[s] - want) <= max(size.values())


def test_html_keeps_what_an_article_says_of_few_values(spark):
    """Lists of yes and no, headings that pages share in part, and names that only sound like boilerplate are the article's."""
    from lexloom.llm import html

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdehlnorst") for _ in range(rng.randrange(2, 8)))
    for pages in (7, 12):
        rows, want = [], {}
        for i in range(pages):
            said = " ".join(word() for _ in range(30))
            answers = rng.choice([("yes", "no"), ("no", "yes"), ("yes", "yes")])
            rows.append((i, "http://h.example/a", f"<body><nav><a href=x>Home</a></nav><main><h1>{word()}</h1><ul><li>{answers[0]}</li><li>{answers[1]}</li></ul><div class='related-work'><h2>Related work</h2><p>{said}</p></div>"
                                                f"<div id=side>Side effects of {said}</div><div class='comments'>nice {word()}</div><p>All rights reserved</p></main><footer>end</footer></body>"))
            want[i] = (list(answers), said)
        got = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        for i, (answers, said) in want.items():
            assert got[i][1:3] == answers and said in got[i] and f"Side effects of {said}" in got[i] and not any("nice" in t or "Home" in t for t in got[i])
            assert ("All rights reserved" in got[i]) == (pages < 8)


def test_near_copies_that_go_are_like_one_that_stays(spark, monkeypatch):
    """Chains of ever fewer shared words and groups of any size, settled in rounds and in tasks: first come, first kept."""
    from lexloom.llm import simhash

    rng = random.Random(6)
    texts = near_copies(spark)[:30]
    chain = [f"w{rng.randrange(5000)}" for _ in range(200)]
    for _ in range(40):
        texts.append(" ".join(chain))
        chain[rng.randrange(200)], chain[rng.randrange(200)] = "other", f"x{rng.randrange(99)}"
    texts += [None, "", "a b", "a b"]
    rng.shuffle(texts)
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset() for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for small in (500, 2):
        monkeypatch.setattr(simhash, "SMALL", small)
        kept = sorted(r.doc_id for r in simhash.survivors(df).collect())
        for i in range(len(texts)):
            if i not in kept:
                assert any(k < i and alike(sets[k], sets[i]) for k in kept), i
        both = [(a, b) for a in kept for b in kept if a < b and alike(sets[a], sets[b])]
        assert len(both) <= 1, both


def test_empty_lines_cost_what_they_are(spark):
    """Many empty lines before a repeated run: its ends are taken, not each of its lines for each of its starts."""
    import time

    from lexloom.llm import lines

    said = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "\n" * 30_000 + said) for i in range(2)] + [(5, "unlike\n" + said)]
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed, len(r.text)) for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (30_001, 0, 30_000 + len(said)), 1: (30_001, 30_001, 0), 5: (2, 1, 6)} and time.time() - began < 120


def test_rounds_leave_no_garbage_on_the_driver(spark):
    """Each round of the near-copy stage collects the garbage of the queries before it, which else fills the driver's heap."""
    from lexloom.llm import simhash

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    swept = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 3}x{j}" for j in range(30)), "en", "s", 0) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    before = swept()
    assert {r.doc_id for r in simhash.survivors(docs).collect()} == {0, 1, 2}
    assert swept() >= before + 6


def test_rounds_of_joins_do_not_square_the_assumed_size(spark):
    """Checkpoints keep the size that Spark assumes of a join, the product of its sides': kept in rounds, its digits doubled with each."""
    from pyspark.sql import functions as F

    from lexloom.llm.common import keep

    x, bits = spark.createDataFrame([(i, [i, None]) for i in range(4)], "a long, b array<int>"), []
    for _ in range(6):
        n = keep(x.groupBy("a").agg(F.count("*").alias("n")))
        x = keep(x.join(n, "a").filter("n = 1").select("a", "b"), sweep=True)
        size = x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        bits.append((size if isinstance(size, int) else int(size.toString())).bit_length())
    assert max(bits) <= 64, bits
    assert sorted((r.a, r.b) for r in x.collect()) == [(i, [i, None]) for i in range(4)]
    assert [(f.name, f.dataType.simpleString()) for f in x.schema.fields] == [("a", "bigint"), ("b", "array<int>")]


def test_a_large_group_takes_rounds_by_its_parts(spark, monkeypatch):
    """A chain whose members mostly stay, and copies in it, take a round a part and leave what comparing all of them in order leaves."""
    from pyspark.sql import functions as F

    from lexloom.llm import simhash

    rng = random.Random(8)
    said = [rng.randrange(1 << 62) for _ in range(4000)]
    sets = [sorted(said[8 * i : 8 * i + 100]) for i in range(300)]
    sets += [sorted(rng.sample(sets[i], 95)) for i in range(0, 300, 3) for _ in range(2)] + [[], [], [7], [7], [7, 8]]
    rng.shuffle(sets)
    rows = [(i % 2, (0, i), s) for i, s in enumerate(sets)] + [(9, (5, i), s) for i, s in enumerate(sets[:7])]
    df = spark.createDataFrame(rows, "component long, key struct<a:long,b:long>, sh array<long>").repartition(5)
    want = []
    for c in (0, 1, 9):
        kept = []
        for _, key, s in (r for r in rows if r[0] == c):
            if not any(len(set(s) & set(t)) >= 0.8 * len(set(s) | set(t)) for t in kept):
                kept.append(s)
                want.append(key)
    rounds, keep = [], simhash.keep
    monkeypatch.setattr(simhash, "keep", lambda x, sweep=False: (rounds.append(sweep), keep(x, sweep))[1])
    for small in (4000, 60):
        monkeypatch.setattr(simhash, "SMALL", small)
        rounds.clear()
        got = sorted(tuple(r) for r in simhash.leaders(df.withColumn("sh", F.sort_array("sh")), 0.8).select("key.*").collect())
        assert got == sorted(want), small
        assert len(want) > 120 and sum(rounds) <= (2 if small == 4000 else 14), (small, len(want), sum(rounds))
