"""Conversations whose rows are faulty, repaired by the cheapest edits.

Rows are edited so that the initials of their roles read ``(s?(ua)+)?``. A row is kept,
given the role user or assistant, or deleted, which blank and duplicate rows have to be;
rows without text may be inserted anywhere. The edits are a path through an acyclic graph
whose nodes are (rows read, rows inserted, state of the pattern) and whose edges weigh one
integer each: high digits hold the cost, below them every position of the audit has a
digit of fixed width for its letter, first position highest, and zeros fill what a shorter
audit leaves. A node fixes the position that its edges write, so the least integer, by
ordinary addition and minimum, is the least cost and among equals the audit that is least
in ASCII order. (An insertion costs more than to delete the two rows around it, so none is
ever among the cheapest edits; the graph has a layer of insertions as long as their price
does not exceed the best cost without.)

Spark does what is about rows: damage, faults, duplicates as a window over (conversation,
role, text), then one sort by conversation and turn. A task reads that order as a stream and
holds a block of rows; a longer conversation goes on from block to block with one path a
state, their audits and running digests, so no conversation is gathered. All of it passes
through one task since its digest is one SHA-256 over all of its text.

Defined results: a null role or text is one space; rows without a turn come first; rows of
one turn are in order of role and text; a null conv_id is a conversation like others; an
empty role has no initial and is never legal; a conversation of which nothing is left has
zeros and an empty audit; an empty table gives no rows; further columns are ignored.
"""

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.llm.common import WORD

# What edits cost, and what a truncated row costs that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# Letters of the audit as digits in ASCII order; zero ends an audit.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = {v: k for k, v in DIGITS.items()}
BITS = 3
# States: nothing said, system said, user said, assistant said; what may follow and what may end.
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
LEGAL = {"su", "ua", "au"}
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long"
SPACES = "\t\n\x0b\x0c\r "


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after damage that their key decides; ``gone`` marks rows that were dropped."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(said("conv_id"), F.lit(":"), said("turn"))
    x = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_d")
    )
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    x = x.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_d") == 0).alias("gone"), F.when(F.col("_d") == 3, 2).otherwise(1).alias("_n"))
    return x.withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")


def faults(rows: DataFrame) -> DataFrame:
    """Adds fault: 0, 1 blank, 2 duplicate or 3 truncated, the first that holds; one shuffle, by conversation."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "text", "gone").orderBy("turn")) > 1
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(seen, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    return rows.repartition("conv_id").withColumn("fault", fault)


@dataclass
class Row:
    role: str
    text: str
    fault: int


@dataclass
class Path:
    """The best edits so far that end in a state: ``rank`` orders the audits of equally long paths, ``trail`` is the audit
    as (what came before, the latest block's)."""

    cost: int
    rank: int
    trail: tuple | None
    digest: "hashlib._Hash"
    begun: bool


def edits(row: Row, state: int):
    """(letter, cost, next state) of what may be done with a row in a state."""
    yield "D", DELETE, state
    if row.fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if row.fault == CUT else 0
    for initial, then in STEPS[state].items():
        if row.role[:1] == initial:
            yield "K", KEEP + more, then
        if ROLES.get(initial, row.role) != row.role:
            yield "R", REROLE + more, then


def cheapest(rows: list[Row], state: int, inserts: int) -> dict[int, tuple[int, str]]:
    """By final state the least (cost, audit) of paths from ``state`` over all rows with at most so many insertions."""
    width = len(rows) + inserts
    weight = lambda letter, cost, at: (cost << BITS * width) + (DIGITS[letter] << BITS * (width - 1 - at))
    best = {(0, state): 0}  # (inserted, state) at the row to come

    def lower(table, node, value):
        if node not in table or value < table[node]:
            table[node] = value

    for i in range(len(rows) + 1):
        for j in range(inserts):
            for s in STEPS:
                if (j, s) in best:
                    for initial, then in STEPS[s].items():
                        if initial in ROLES:
                            lower(best, (j + 1, then), best[j, s] + weight("I", INSERT, i + j))
        if i < len(rows):
            then_best: dict[tuple[int, int], int] = {}
            for (j, s), value in best.items():
                for letter, cost, then in edits(rows[i], s):
                    lower(then_best, (j, then), value + weight(letter, cost, i + j))
            best = then_best
    out: dict[int, int] = {}
    for (_, s), value in best.items():
        lower(out, s, value)
    return {s: (value >> BITS * width, read_audit(value, width)) for s, value in out.items()}


def read_audit(value: int, width: int) -> str:
    digits = ((value >> BITS * (width - 1 - p)) & (1 << BITS) - 1 for p in range(width))
    return "".join(LETTERS[d] for d in digits if d)


def applied(rows: list[Row], audit: str, state: int):
    """(role, text) of the rows that edits leave."""
    at = iter(rows)
    for letter in audit:
        row = Row("", "", FINE) if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter == "K":
            role, initial = row.role, row.role[:1]
        else:
            initial = "a" if state == 2 else "u"
            role = ROLES[initial]
        state = STEPS[state][initial]
        yield role, row.text


class Conversation:
    """Rows of one conversation in order, block by block."""

    def __init__(self, ident):
        self.ident, self.block, self.bytes, self.blocks = ident, [], 0, 0
        self.paths = {0: Path(0, 0, None, hashlib.sha256(), False)}
        self.counts, self.illegal, self.rows, self.role = [0, 0, 0, 0], 0, 0, None
        self.first = self.last = None
        self.turns = 0

    def add(self, turn, row: Row) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.rows and self.role + row.role[:1] not in LEGAL:
            self.illegal += 1
        self.role, self.rows = row.role[:1], self.rows + 1
        self.counts[row.fault] += 1
        if len(self.block) == BLOCK_ROWS or self.bytes > BLOCK_BYTES:
            self.go_on(0)
        self.block.append(row)
        self.bytes += len(row.text)

    def go_on(self, inserts: int) -> None:
        """Every state's best path over the block; equally long audits compare by the rank of what came before, then by the block's."""
        found: dict[int, list] = {}
        for s, path in self.paths.items():
            for then, (cost, audit) in cheapest(self.block, s, inserts).items():
                found.setdefault(then, []).append((path.cost + cost, path.rank, audit, s))
        best = {then: min(some) for then, some in found.items()}
        order = sorted({(rank, audit) for _, rank, audit, _ in best.values()})
        new = {}
        for then, (cost, rank, audit, s) in best.items():
            path, digest = self.paths[s], self.paths[s].digest.copy()
            begun = path.begun
            for role, text in applied(self.block, audit, s):
                digest.update(("\n" * begun + role + ":").encode())
                digest.update(text.encode())
                begun = True
            new[then] = Path(cost, order.index((rank, audit)), (path.trail, audit), digest, begun)
        self.paths, self.block, self.bytes, self.blocks = new, [], 0, self.blocks + 1

    def result(self) -> tuple:
        inserts = 0
        if not self.blocks:
            without = cheapest(self.block, 0, 0)
            inserts = min(without[s][0] for s in ENDS if s in without) // INSERT
        self.go_on(inserts)
        end = min((self.paths[s] for s in ENDS if s in self.paths), key=lambda p: (p.cost, p.rank))
        parts, trail = [], end.trail
        while trail:
            trail, part = trail
            parts.append(part)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.ident, min(gaps, (1 << 63) - 1), *self.counts[1:], self.illegal, end.cost, "".join(reversed(parts)), end.digest.hexdigest(), self.rows)


def repaired(rows: DataFrame) -> DataFrame:
    """A row a conversation of rows (conv_id, turn, role, text, gone, fault): its faults, the cost and audit of the cheapest
    edits, and the digest of what they leave, ``role:text`` a line. Rows that are ``gone`` count for nothing but the conversation itself."""

    def run(batches):
        out, now = [], None

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i in (7, 8) else pa.int64()) for i in range(10)], [c.split()[0] for c in SCHEMA.split(", ")])

        for b in batches:
            for ident, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or ident != now.ident:
                    if now is not None:
                        out.append(now.result())
                    now = Conversation(ident)
                if not gone:
                    now.add(turn, Row(role, text, fault))
            if out:
                yield batch()
                out = []
        if now is not None:
            out.append(now.result())
            yield batch()

    x = rows.select("conv_id", "turn", "role", "text", "gone", "fault")
    return x.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(run, SCHEMA)


def repair(rows: DataFrame) -> DataFrame:
    return repaired(faults(rows))


