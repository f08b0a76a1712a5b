"""Byte-level BPE, encoding and decoding, with a rank queue of hierarchical bitmaps.

A text is cut by the pre-tokenizer's pattern. Inside a pre-token the bytes form a linked
list; every neighbouring pair that the vocabulary knows stands by its position in the bucket
of its rank. A tree of 64-bit words says which buckets hold anything: finding the first set
bit from the root down gives the lowest rank in three steps, however many pairs wait. The
lowest position of that bucket is merged and its two new pairs are entered; an entry whose
pair has changed meanwhile is stale and passed over. A pre-token of n bytes so takes
n log n steps, and no byte is looked at again, which a pre-token of megabytes needs.

Short pre-tokens wait in one queue, those of several texts together: a step merges the
first pair of the lowest rank in each of them. Frequent ones are merged once a task and
then looked up, in a cache bounded in entries and in the length of each.

Defined results: a null or empty text has no ids; ids that the vocabulary lacks decode to
nothing and null ids to null; repeated rows, null and repeated keys are rows like others;
an empty table gives no rows; other columns stay where they are asked for.
"""

import base64
from array import array
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import text_of
from lexloom.llm.packing import SPLIT, UNSAFE

#: The pattern that SPLIT states for texts without UNSAFE characters.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHED = 500_000  # pre-tokens, of some 200 bytes each
LONGEST = 64  # characters of a cached pre-token
SHORT = 256  # bytes; longer pre-tokens live in arrays of four bytes an entry
CHARS_AT_ONCE = 8 << 20  # of texts whose new pre-tokens are merged together
MISSING_AT_ONCE = 200_000  # of those pre-tokens


class Run:
    """A large bucket: ascending positions in four bytes each, and a heap of those that come later."""

    def __init__(self, positions: np.ndarray):
        self.positions, self.at, self.later = array("i", positions.astype(np.int32).tobytes()), 0, []

    def __bool__(self) -> bool:
        return self.at < len(self.positions) or bool(self.later)

    def push(self, position: int) -> None:
        heappush(self.later, position)

    def pop(self) -> int:
        if self.later and (self.at == len(self.positions) or self.later[0] < self.positions[self.at]):
            return heappop(self.later)
        self.at += 1
        return self.positions[self.at - 1]


class Bpe:
    """Ids of texts by a file of ranks (a line each: base64 of the bytes, rank), and back."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            by_id[i] = b
        self.flat, self.sizes = np.frombuffer(b"".join(by_id), np.uint8), np.array([len(b) for b in by_id], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # Words of 64 bits; wider ones only where the ranks need more than three levels of them.
        most = max(self.ranks.values())
        self.shift = max(6, -(-most.bit_length() // 3))
        self.leaf = [0] * ((most >> self.shift) + 1)
        self.inner = [0] * ((len(self.leaf) - 1 >> self.shift) + 1)
        self.buckets: dict[int, list[int] | Run] = {}
        pairs = np.full((256, 256), -1, np.int32)
        for b, i in self.ranks.items():
            if len(b) == 2:
                pairs[b[0], b[1]] = i
        self.pairs = pairs
        self.strange, own = own_classes(pattern)
        self.split, self.strange_split = regex.compile(pattern).findall, regex.compile(own).findall
        self.plain, self.known = pattern == PLAIN, {}
        self.found, self.missing, self.n_missing = [], [], 0
        # Every way to put a token together from two, as sorted keys with the rank of the whole.
        self.width = most + 1
        parts = [(self.ranks[b[:k]] * self.width + self.ranks[b[k:]], i) for b, i in self.ranks.items() for k in range(1, len(b)) if b[:k] in self.ranks and b[k:] in self.ranks]
        parts.sort()
        self.keys, self.whole = np.array([k for k, _ in parts], np.int64), np.array([i for _, i in parts], np.int64)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbouring tokens, -1 where the vocabulary has none."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((b >= 0) & (self.keys[at] == key), self.whole[at], -1)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids (as bytes) of many short pre-tokens, which wait in one queue: a step takes the lowest rank and merges its first
        pair in every pre-token at once; what the bucket holds beyond goes back into it."""
        shift, leaf, inner, buckets, root = self.shift, self.leaf, self.inner, self.buckets, 0
        low = (1 << shift) - 1
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        word_of = np.repeat(np.arange(len(words)), sizes)
        token = np.append(self.single[raw], -1)  # one more place, for what lies beyond an end
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[ends - sizes] = n, -1
        waiting = np.full(n + 1, -1, np.int64)
        waiting[: n - 1] = self.pairs[raw[:-1], raw[1:]]
        waiting[ends - 1] = -1
        order = np.argsort(waiting, kind="stable")
        order = order[np.searchsorted(waiting[order], 0) :]
        values, starts = np.unique(waiting[order], return_index=True)
        early = dict(zip(values.tolist(), np.split(order, starts[1:])))  # what the buckets hold to begin with
        fresh = [(rank, -1) for rank in early]
        while True:
            for rank, at in fresh:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [at] if at >= 0 else []
                    word = rank >> shift
                    bits = leaf[word]
                    leaf[word] = bits | 1 << (rank & low)
                    if not bits:
                        inner[word >> shift] |= 1 << (word & low)
                        root |= 1 << (word >> shift)
                else:
                    bucket.append(at)
            if not root:
                break
            top = (root & -root).bit_length() - 1
            bits = inner[top]
            word = (top << shift) + (bits & -bits).bit_length() - 1
            bits = leaf[word]
            rank = (word << shift) + (bits & -bits).bit_length() - 1
            at = np.array(buckets.pop(rank), np.int64)
            if rank in early:
                at = np.append(early.pop(rank), at)
            leaf[word] = bits = bits & (bits - 1)
            if not bits:
                inner[top] = bits = inner[top] & (inner[top] - 1)
                if not bits:
                    root &= root - 1
            at = at[waiting[at] == rank]  # the others are stale
            if not len(at):
                fresh = []
                continue
            fresh = []
            if len(at) > 1:
                at.sort()
                own = word_of[at]
                more = own[1:] == own[:-1]
                if more.any():
                    fresh = [(rank, i) for i in at[1:][more].tolist()]
                    at = at[np.append(True, ~more)]
            gone = after[at]
            end = after[gone]
            after[at], before[end], token[at], waiting[gone] = end, at, rank, -1
            waiting[at] = new = self.ranks_of(token[at], token[end])
            some = new >= 0
            fresh += zip(new[some].tolist(), at[some].tolist())
            left = before[at]
            some = left >= 0
            left, right = left[some], at[some]
            waiting[left] = new = self.ranks_of(token[left], token[right])
            some = new >= 0
            fresh += zip(new[some].tolist(), left[some].tolist())
        # What can still be reached from the first bytes stands.
        stands, at = np.zeros(n + 1, bool), ends - sizes
        while len(at):
            stands[at] = True
            at = after[at]
            at = at[at < n]
        ids, of = token[:n][stands[:n]].astype("<i4"), word_of[stands[:n]]
        cut = np.searchsorted(of, np.arange(len(words) + 1))
        flat = ids.tobytes()
        return [flat[4 * a : 4 * z] for a, z in zip(cut.tolist(), cut[1:].tolist())]

    def look_up(self, words: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens that are not cached yet; short ones are merged together, long ones one by one."""
        out, short = {}, []
        for w in words:
            b = w.encode()
            if b in self.ranks:
                out[w] = np.array([self.ranks[b]], "<i4").tobytes()
            elif len(b) < SHORT:
                short.append((w, b))
            else:
                out[w] = np.array(self.merge(b), "<i4").tobytes()
        if short:
            out.update(zip([w for w, _ in short], self.merge_all([b for _, b in short])))
        return out

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: itself if the vocabulary has it, else its bytes, merged lowest rank first.

        The queue has three levels of words over the ranks: a bit of ``root`` says that a word of ``inner`` has any, a bit
        there that a word of ``leaf`` has, and a bit there that the bucket of a rank has. It is empty before and after.
        """
        ranks, n = self.ranks, len(data)
        if data in ranks:
            return [ranks[data]]
        rank_of, shift, leaf, inner, buckets, root = ranks.get, self.shift, self.leaf, self.inner, self.buckets, 0
        low = (1 << shift) - 1
        # ``waiting``: the rank of the pair that begins at a position, -1 if there is none.
        if n < SHORT:
            after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
            waiting = [rank_of(data[i : i + 2], -1) for i in range(n - 1)]
            fresh = [(r, i, None) for i, r in enumerate(waiting) if r >= 0]
        else:
            after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
            raw = np.frombuffer(data, np.uint8)
            known = self.pairs[raw[:-1], raw[1:]]
            waiting = array("i", known.tobytes())
            order = np.argsort(known, kind="stable")
            order = order[np.searchsorted(known[order], 0) :]
            values, starts = np.unique(known[order], return_index=True)
            fresh = [(r, -1, Run(some)) for r, some in zip(values.tolist(), np.split(order, starts[1:]))]
        waiting.append(-1)
        while True:
            for rank, at, run in fresh:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = run or [at]
                    word = rank >> shift
                    bits = leaf[word]
                    leaf[word] = bits | 1 << (rank & low)
                    if not bits:
                        inner[word >> shift] |= 1 << (word & low)
                        root |= 1 << (word >> shift)
                elif type(bucket) is list:
                    heappush(bucket, at)
                else:
                    bucket.push(at)
            if not root:
                break
            # Find first set, from the root down.
            top = (root & -root).bit_length() - 1
            bits = inner[top]
            word = (top << shift) + (bits & -bits).bit_length() - 1
            bits = leaf[word]
            rank = (word << shift) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            at = heappop(bucket) if type(bucket) is list else bucket.pop()
            if not bucket:
                del buckets[rank]
                leaf[word] = bits = bits & (bits - 1)
                if not bits:
                    inner[top] = bits = inner[top] & (inner[top] - 1)
                    if not bits:
                        root &= root - 1
            fresh = []
            if waiting[at] != rank:
                continue  # stale
            gone = after[at]
            end = after[gone]
            after[at] = end
            waiting[gone] = waiting[at] = -1
            if end < n:
                before[end] = at
                new = rank_of(data[at : after[end]], -1)
                if new >= 0:
                    waiting[at] = new
                    fresh.append((new, at, None))
            left = before[at]
            if left >= 0:
                new = waiting[left] = rank_of(data[left:end], -1)
                if new >= 0:
                    fresh.append((new, left, None))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : after[at]]])
            at = after[at]
        return out

    def pre_tokens(self, text: str) -> list[str]:
        if self.plain and not UNSAFE.search(text):
            return SPLIT(text)
        return self.split(text) if self.strange.isdisjoint(text) else self.strange_split(text)

    def look(self, text: str) -> None:
        """Takes a text up: what the cache lacks waits, with the texts before it, for ``settle``."""
        words = self.pre_tokens(text)
        ids = list(map(self.known.get, words))
        if None in ids:
            own = [(i, w) for i, (w, v) in enumerate(zip(words, ids)) if v is None]
            self.missing.append((ids, own))
            self.n_missing += len(own)
        self.found.append(ids)

    def settle(self) -> list[np.ndarray]:
        """Ids of the texts taken up, whose new pre-tokens are merged together."""
        new = self.look_up({w for _, own in self.missing for _, w in own})
        for ids, own in self.missing:
            for i, w in own:
                ids[i] = new[w]
        self.known.update(islice(((w, v) for w, v in new.items() if len(w) <= LONGEST), max(0, CACHED - len(self.known))))
        found, self.found, self.missing, self.n_missing = self.found, [], [], 0
        return [np.frombuffer(b"".join(ids), "<i4") for ids in found]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        for t in texts:
            self.look(t)
        return self.settle()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of known ids one after the other, gathered from one table of all tokens' bytes."""
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ids) else 0)].tobytes()


def own_classes(pattern: str):
    """(characters that the two libraries class differently, the pattern with the classes of tiktoken).

    Letters and numbers are those of a Unicode version; characters that were assigned since tiktoken's tables were made
    count there as neither. They are found by asking both about all code points that Python's own tables do not know.
    """
    import unicodedata

    import regex
    import tiktoken

    new = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
    single, odd = {bytes([i]): i for i in range(256)}, {}
    for name in (r"\p{L}", r"\p{N}"):
        theirs, here = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={}), regex.compile(name)
        odd[name] = "".join(c for c in new if here.match(c) and not theirs.encode_ordinary(c))
        pattern = pattern.replace(name, f"[{name}--[{odd[name]}]]") if odd[name] else pattern
    return frozenset("".join(odd.values())), "(?V1)" + pattern


_MADE: dict[tuple, Bpe] = {}


def bpe(path: str, pattern: str) -> Bpe:
    """One a worker process."""
    if (path, pattern) not in _MADE:
        _MADE.clear()
        _MADE[path, pattern] = Bpe(path, pattern)
    return _MADE[path, pattern]


def kept_schema(columns: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in columns.schema)


def encode(docs: DataFrame, path: str, pattern: str, columns: list[str | Column], text: str = "text") -> DataFrame:
    """``columns`` of every row with ids (array<int>) of its whole text."""
    x = docs.select(text_of(text).alias("_text"), *columns)

    def run(batches):
        own = bpe(path, pattern)
        for b in batches:
            rest = b.select(b.schema.names[1:])
            start, chars = 0, 0
            for i, t in enumerate(b.column(0)):
                text = t.as_py()
                own.look(text)
                chars += len(text)
                if chars >= CHARS_AT_ONCE or own.n_missing >= MISSING_AT_ONCE or i + 1 == len(b):
                    found = own.settle()
                    ends = np.cumsum([0, *map(len, found)])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([*rest.slice(start, len(found)).columns, ids], [*rest.schema.names, "ids"])
                    start, chars = i + 1, 0

    return x.mapInArrow(run, kept_schema(x.drop("_text")) + "ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds decoded (binary): the bytes that the ids of each row stand for."""
    x = coded.select("ids", *[c for c in coded.columns if c != "ids"])

    def run(batches):
        own = bpe(path, pattern)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                back = [None if i.as_py() is None else own.decode(i.values.to_numpy()) for i in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.binary())], [*part.schema.names, "decoded"])

    return x.mapInArrow(run, kept_schema(x) + "decoded binary")
