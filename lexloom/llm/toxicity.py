"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens do not, so tokens are labelled from them: a token of
a toxic document counts as toxic if its word, or one of its prefixes, is significantly
more frequent in toxic than in clean training documents. A two-state chain over these
labels is trained by gradient steps on its exact likelihood; its emissions are
weights of the word and of its prefixes of three to six letters. Forward-backward marginals give every
token of a text a probability; their maximum and sum give the document's score
through a logistic fit, and tokens above one half are the offending spans.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows of each class (a
documented bound; chosen by hash); every text is scored whole.

Defined results: null and empty texts have no token and score the logistic fit of
none; without training rows of both classes every score is 0; repeated rows score
alike; an empty table gives no rows; further columns pass by.
"""

import re
from array import array
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import text_of

TRAIN_ROWS = 1200
CHARS_AT_ONCE = 1 << 20
TOKEN = re.compile(r"[^\W_]+")
STEP = 64
CLIP = 30
PREFIXES = (3, 4, 5, 6)


def features(word: str) -> list[str]:
    return ["=" + word] + [word[:n] for n in PREFIXES if len(word) >= n]


def lowered(text: str) -> str:
    """Lower-cased, character by character where that would change the length, so that offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(lowered(text))


def messages(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages: each token's share of state 1 by what stands up to it, and by what follows it.
    ``first`` marks where one of the concatenated texts begins.

    The chain is cut into columns of STEP tokens that advance together: products of
    transition matrices carry messages over a column, a short scan joins the columns,
    and a second sweep gives each token's messages. A text's first token has a matrix
    whose rows agree, which forgets what came before.
    """
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros(0)
    cols = -(-n // STEP)
    e, f = np.zeros(cols * STEP), np.ones(cols * STEP, bool)
    e[:n], f[:n] = np.clip(emit, -CLIP, CLIP), first
    e, f = np.exp(e.reshape(cols, STEP).T), f.reshape(cols, STEP).T
    t, s = np.exp(trans), np.exp(start)
    a00, a10 = np.where(f, s[0], t[0, 0]), np.where(f, s[0], t[1, 0])
    a01, a11 = np.where(f, s[1], t[0, 1]) * e, np.where(f, s[1], t[1, 1]) * e
    p = [np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)]
    for k in range(STEP):
        p = [p[0] * a00[k] + p[1] * a10[k], p[0] * a01[k] + p[1] * a11[k], p[2] * a00[k] + p[3] * a10[k], p[2] * a01[k] + p[3] * a11[k]]
        scale = np.maximum(np.maximum(p[0], p[1]), np.maximum(p[2], p[3]))
        p = [v / scale for v in p]
    rows = list(zip(*(v.tolist() for v in p)))
    x, heads = 0.5, []
    for m in rows:
        heads.append(x)
        u, v = (1 - x) * m[0] + x * m[2], (1 - x) * m[1] + x * m[3]
        x = v / (u + v)
    x, tails = 0.5, []
    for m in reversed(rows):
        tails.append(x)
        u, v = m[0] * (1 - x) + m[1] * x, m[2] * (1 - x) + m[3] * x
        x = v / (u + v)
    x, fore = np.array(heads), np.empty((STEP, cols))
    for k in range(STEP):
        u, v = (1 - x) * a00[k] + x * a10[k], (1 - x) * a01[k] + x * a11[k]
        x = fore[k] = v / (u + v)
    x, back = np.array(tails[::-1]), np.empty((STEP, cols))
    for k in range(STEP - 1, -1, -1):
        back[k] = x
        u, v = a00[k] * (1 - x) + a01[k] * x, a10[k] * (1 - x) + a11[k] * x
        x = v / (u + v)
    return fore.T.ravel()[:n], back.T.ravel()[:n]


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of state 1 for every token."""
    fore, back = messages(emit, first, trans, start)
    on = fore * back
    return on / (on + (1 - fore) * (1 - back))


def gradient(y: np.ndarray, emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log-likelihood of the states y by emissions, transitions and start: what is observed less what forward and
    backward messages, of pairs of neighbours for transitions, lead to expect."""
    fore, back = messages(emit, first, trans, start)
    on = fore * back
    p = on / (on + (1 - fore) * (1 - back))
    go = np.nonzero(~first)[0]
    f, b, e = fore[go - 1], back[go], np.exp(np.clip(emit[go], -CLIP, CLIP))
    pair = [(1 - f) * (1 - b), (1 - f) * e * b, f * (1 - b), f * e * b]
    pair = [w * t for w, t in zip(pair, np.exp(trans).ravel())]
    whole = sum(pair)
    expected = np.array([(w / whole).sum() for w in pair]).reshape(2, 2)
    observed = np.bincount((2 * y[go - 1] + y[go]).astype(int), minlength=4).reshape(2, 2)
    begin = np.array([(p[first] - y[first]).sum(), (y[first] - p[first]).sum()])
    return y - p, observed - expected, begin


def summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: the largest marginal, the log of their sum; rows of a design matrix."""
    out = np.zeros((len(sizes), 3))
    out[:, 0] = 1
    has = sizes > 0
    if has.any():
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])[has]
        out[has, 1], out[has, 2] = np.maximum.reduceat(p, at), np.log1p(np.add.reduceat(p, at))
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - q)) - ridge * w)
    return w


def train(toxic: list[str], clean: list[str], rates: tuple[float, float], rounds: int = 30) -> dict | None:
    """A model of plain numbers and dictionaries. rates: labelled toxic and clean rows behind the samples."""
    if not toxic or not clean:
        return None
    seen = [Counter(f for t in texts for w in set(tokens(t)) for f in set(features(w))) for texts in (toxic, clean)]

    share = len(toxic) / (len(toxic) + len(clean))
    bar = 2 * np.log(len(seen[0]) + 1) + 4  # keeps chance out, however many features are looked at

    def telling(f, n):
        """Whether the log-likelihood ratio of a feature's counts against both classes' sizes points to the toxic one."""
        m = seen[1][f]
        g = 2 * (n * np.log(n / ((n + m) * share)) + (m * np.log(m / ((n + m) * (1 - share))) if m else 0))
        return g > bar and (n + 0.1) / (len(toxic) + 1) > 20 * (m + 0.1) / (len(clean) + 1)

    likely = {f for f, n in seen[0].items() if telling(f, n)}
    # Copies repeat a word in one place; evidence counts each pair of neighbours once.
    around = set()
    for t in toxic:
        words = ["", *tokens(t), ""]
        around.update((f, words[i - 1], words[i + 1]) for i in range(1, len(words) - 1) for f in features(words[i]) if f in likely)
    places = Counter(f for f, _, _ in around)
    cues = {f for f in likely if telling(f, min(seen[0][f], places[f]))}
    # Labels from the documents: tokens of toxic ones that hold a cue. Training reads each cue's neighbourhood and the clean texts.
    names, counts, what, labels, first = {}, array("i"), array("i"), array("b"), array("b")
    for texts, bad in ((toxic, True), (clean, False)):
        for t in texts:
            words = tokens(t)
            for i, w in enumerate(words):
                f = features(w)
                used = [names.setdefault(x, len(names)) for x in f if x in cues or seen[0][x] + seen[1][x] >= 20]
                counts.append(len(used))
                what.extend(used)
                labels.append(bad and any(x in cues for x in f))
                first.append(i == 0)
    del seen
    y, first, what = np.array(labels, float), np.array(first, bool), np.array(what, np.int32)
    where = np.repeat(np.arange(len(y), dtype=np.int32), np.array(counts))
    weights, trans, start, bias = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2), -3.0
    gram, gram_bias, gram_t, gram_s = np.full(len(names), 1e-6), 1e-6, np.full((2, 2), 1e-6), np.full(2, 1e-6)
    for _ in range(rounds):
        off, gt, gs = gradient(y, np.bincount(where, weights[what], len(y)) + bias, first, trans, start)
        g = np.bincount(what, off[where], len(names)) - 0.1 * weights
        gram, gram_bias, gram_t, gram_s = gram + g * g, gram_bias + off.sum() ** 2, gram_t + gt * gt, gram_s + gs * gs
        weights, bias = weights + g / np.sqrt(gram), bias + 0.5 * off.sum() / np.sqrt(gram_bias)
        trans, start = trans + 0.2 * gt / np.sqrt(gram_t), start + 0.2 * gs / np.sqrt(gram_s)
    p = marginals(np.bincount(where, weights[what], len(y)) + bias, first, trans, start)
    sizes = np.array([len(tokens(t)) for t in (*toxic, *clean)])
    target = np.repeat([1.0, 0.0], [len(toxic), len(clean)])
    weight = np.repeat([rates[0] / len(toxic), rates[1] / len(clean)], [len(toxic), len(clean)])
    fit = logistic(summary(p, sizes), target, weight / weight.mean())
    return {"weights": {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 1e-3}, "bias": float(bias), "trans": trans, "start": start, "fit": fit}


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """Trains on labelled rows outside the held-out fifth: at most about ``rows`` a class reach the driver."""
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    marked = labels.filter(~out & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("_id"), "toxic").distinct()
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    chance = F.when(F.col("toxic") == 1, min(1.0, rows / n[1])).otherwise(min(1.0, rows / n[0]))
    u = F.pmod(F.xxhash64("_id", F.lit(21)), F.lit(1 << 30)) / float(1 << 30)
    some = F.broadcast(marked.filter(u < chance))  # about two times ``rows`` ids
    found = docs.select(F.col("doc_id").alias("_doc"), text_of("text").alias("text")).join(some, F.col("_doc") == F.col("_id")).select("text", "toxic")
    got = found.orderBy(F.xxhash64("text", "toxic"), "text").limit(4 * rows).collect()  # ids may repeat
    got = sorted((r["text"], r["toxic"]) for r in got)
    return train([t for t, y in got if y], [t for t, y in got if not y], (n[1], n[0]))


SPANS = "array<struct<start:int,end:int,p:double>>"


def score(docs: DataFrame, model: dict | None, keep: list[str], spans: bool = True) -> DataFrame:
    """``keep`` columns, score and, if asked for, spans: offsets in code points of the text's tokens and their marginals."""
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double" + (f", spans {SPANS}" if spans else "")

    def run(batches):
        class Emit(dict):
            def __missing__(self, word):
                got = model["bias"] + sum(map(model["weights"].get, features(word), [0.0] * 5))
                if len(self) < 300_000:
                    self[word] = got
                return got

        emit = Emit().__getitem__ if model else None

        def part(texts):
            """Scores and spans of some whole texts."""
            if model is None:
                return np.zeros(len(texts)), [[]] * len(texts)
            found = [tokens(t) for t in texts]
            sizes = np.array([len(f) for f in found], int)
            first = np.zeros(sizes.sum(), bool)
            first[np.concatenate([[0], np.cumsum(sizes)[:-1]])[sizes > 0]] = True
            p = marginals(np.fromiter((e for f in found for e in map(emit, f)), float, sizes.sum()), first, model["trans"], model["start"])
            out = 1 / (1 + np.exp(-np.clip(summary(p, sizes) @ model["fit"], -30, 30)))
            marks, at = [], 0
            for t, n in zip(texts, sizes):
                hot = set(np.nonzero(p[at : at + n] > 0.5)[0].tolist()) if spans else ()
                marks.append([{"start": m.start(), "end": m.end(), "p": float(p[at + i])} for i, m in enumerate(TOKEN.finditer(lowered(t))) if i in hot] if hot else [])
                at += n
            return out, marks

        for b in batches:
            texts = b["text"].fillna("") if "text" in keep else b.pop("_text")
            ends = np.cumsum(texts.str.len().to_numpy()) // CHARS_AT_ONCE
            cuts = [0, *(np.nonzero(np.diff(ends))[0] + 1).tolist(), len(texts)]
            got = [part(texts.iloc[i:j].tolist()) for i, j in zip(cuts, cuts[1:])]
            b = b.assign(score=np.concatenate([g[0] for g in got]))
            yield b.assign(spans=[m for g in got for m in g[1]]) if spans else b

    return docs.select(*keep, *([] if "text" in keep else [text_of("text").alias("_text")])).mapInPandas(run, schema)
