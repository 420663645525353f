"""Conversation repair: the cheapest edits that give each conversation a legal order of roles.

Three weighted machines are composed: the rows as an acceptor, an edit transducer (keep, change the role, delete, insert)
and the grammar of role initials. The composition is never built: a state is a row's place and a state of the grammar, and its arcs
are made when they are asked for. Weights are pairs of a cost and the edits' initials, compared in this order. Places are
a topological order, so the shortest distance to the end is found from the last row to the first; there a label is put before
what follows, which keeps the order of strings (appending would not, where one string starts another).

Conversations of any length are cut into pieces of at most BLOCK rows. A piece gives the cost from each grammar state
to each; those, taken from the last piece to the first, give what every piece has still before it. Then each piece is
walked by itself, from each state that it may be entered in, and a fold over pieces picks the walks that meet. No row waits
for a whole conversation, and only a fold's running hash and its pieces' summaries pass through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, written

#: Rows of a piece, a power of two.
BLOCK = 128
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: What a truncated row costs that stays.
TRUNCATED_COST = 1
#: The grammar (s?(ua)+)?: state to initial to state, and its accepting states.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTING = (0, 3)
START, STATES = 0, tuple(GRAMMAR)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, CUT = range(4)
NEVER = 1 << 60
SPACE = " \t\n\x0b\x0c\r"

Row = tuple[str, int]


def row_arcs(state: int, row: Row) -> Iterator[tuple[str, int, int]]:
    """Arcs that read a row (its initial and fault): label, cost and the grammar's next state."""
    initial, fault = row
    yield DELETE, COST[DELETE], state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED_COST * (fault == CUT)
    if initial in GRAMMAR[state]:
        yield KEEP, COST[KEEP] + more, GRAMMAR[state][initial]
    for out, after in GRAMMAR[state].items():
        if out in ROLES:
            yield REROLE, COST[REROLE] + more, after


def insert_arcs(state: int) -> Iterator[tuple[str, int, int]]:
    """Arcs that read nothing."""
    for out, after in GRAMMAR[state].items():
        if out in ROLES:
            yield INSERT, COST[INSERT], after


def with_inserts(costs: list[int]) -> list[int]:
    """The distances, if any inserts may come first; a shortest path passes no state twice."""
    for _ in STATES:
        costs = [min([costs[g], *(c + costs[h] for _, c, h in insert_arcs(g))]) for g in STATES]
    return costs


def before(row: Row, after: list[int]) -> list[int]:
    """Distances to the end before a row (and before inserts there), of those after it."""
    return with_inserts([min(c + after[h] for _, c, h in row_arcs(g, row)) for g in STATES])


#: Distances after the last row.
AT_END = with_inserts([0 if g in ACCEPTING else NEVER for g in STATES])


def cost_matrix(rows: list[Row]) -> list[int]:
    """The least cost of a piece from each state to each, row by row of the matrix."""
    columns = []
    for last in STATES:
        costs = [0 if g == last else NEVER for g in STATES]
        for row in reversed(rows):
            costs = before(row, costs)
        columns.append(costs)
    return [min(columns[h][g], NEVER) for g in STATES for h in STATES]


def ahead(matrix: list[int], after: list[int]) -> list[int]:
    """Distances to the end before a piece, of those after it."""
    return [min(min(matrix[g * len(STATES) + h] + after[h] for h in STATES), NEVER) for g in STATES]


def walk(rows: list[Row], state: int, after: list[int], last: bool) -> tuple[str, list[tuple[int, str]], int]:
    """The least string of edits among the cheapest, what it gives (row or -1, initial; "" is kept as it is) and the last state.

    A label determines the next state, so the least next label is the least string's.
    """
    togo = [after]
    for row in reversed(rows):
        togo.append(before(row, togo[-1]))
    togo.reverse()
    labels, out, i = [], [], 0
    while True:
        rest = togo[i][state]
        arcs = [(label, h, False) for label, c, h in insert_arcs(state) if (i < len(rows) or last) and c + togo[i][h] == rest]
        if i < len(rows):
            arcs += [(label, h, True) for label, c, h in row_arcs(state, rows[i]) if c + togo[i + 1][h] == rest]
        elif not last or not rest:
            return "".join(labels), out, state
        label, state_after, reads = min(arcs)
        labels.append(label)
        if label != DELETE:
            symbol = "" if label == KEEP else next(s for s, h in GRAMMAR[state].items() if h == state_after and s in ROLES)
            out.append((i if reads else -1, symbol))
        state, i = state_after, i + reads


def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded number."""
    held: list[tuple] = []
    full = lambda: pa.RecordBatch.from_arrays([pa.array([r[j] for r in held], t) for j, (_, t) in enumerate(schema)], [n for n, _ in schema])
    for row in rows:
        held.append(row)
        if len(held) == 64:
            yield full()
            held.clear()
    yield full()


PIECE = [("conv_id", pa.int64()), ("block", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64()))]
PIECE_SQL = "conv_id long, block long, roles array<string>, texts array<string>, faults array<int>, costs array<long>"
WALK = [("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("edits", pa.string()), ("cost", pa.int64()), ("initials", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
WALK_SQL = "conv_id long, block long, entry int, exit int, edits string, cost long, initials array<string>, roles array<string>, texts array<string>"


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null roles and texts: a space), at (the place in the order of all conversations), fault.

    Rows of a conversation go by turn (nulls first), then role and text. A fault is the first of blank, duplicate
    (role and text seen earlier) and truncated. Places are those of a written table of ranges, so a conversation may have any share.
    """
    own = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    ordered = written(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")
    same = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text"), 256)
    marked = ordered.withColumn("same", same)
    first = marked.groupBy("same").agg(F.min("at").alias("first_at"), F.count("*").alias("n")).where("n > 1").select("same", "first_at")
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.col("at") > F.col("first_at"), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    return marked.join(first, "same", "left").select("conv_id", "turn", "role", "text", "at", fault.alias("fault"))


def walks(faulty: DataFrame) -> DataFrame:
    """For each piece of a conversation and each state that it may be entered in: its edits, what they give, its last state."""
    prepare(faulty.sparkSession)
    block = F.shiftright("at", BLOCK.bit_length() - 1)
    dealt = faulty.select("conv_id", block.alias("block"), "role", "text", "fault", "at").repartition("block").sortWithinPartitions("at")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[tuple]:
            for (conv, block), own in groupby(streamed(batches), lambda r: r[:2]):
                roles, texts, faults = map(list, zip(*(r[2:5] for r in own)))
                yield conv, block, roles, texts, faults, cost_matrix([(r[:1], f) for r, f in zip(roles, faults)])

        yield from _batches(run(), PIECE)

    cut = written(dealt.mapInArrow(pieces, PIECE_SQL), "turn-pieces")

    def behind(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[tuple]:
            for conv, own in groupby(streamed(batches), lambda r: r[0]):
                held, after, last = None, AT_END, True
                for _, block, costs in own:
                    if held:
                        yield *held, False
                    held, after, last = (conv, block, after, last), ahead(costs, after), False
                yield *held, True

        yield from _batches(run(), [("conv", pa.int64()), ("block_of", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_()), ("first", pa.bool_())])

    summary = cut.select("conv_id", "block", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    ends = written(summary.mapInArrow(behind, "conv long, block_of long, after array<long>, last boolean, first boolean"), "turn-ends")
    both = cut.join(ends, (F.col("block") == F.col("block_of")) & F.col("conv_id").eqNullSafe(F.col("conv")))

    def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[tuple]:
            for conv, block, roles, texts, faults, after, last, first in streamed(batches):
                rows = [(r[:1], f) for r, f in zip(roles, faults)]
                for entry in (START,) if first else STATES:
                    edits, out, exit_ = walk(rows, entry, after, last)
                    cost = sum(COST[e] for e in edits) + sum(TRUNCATED_COST for i, _ in out if i >= 0 and faults[i] == CUT)
                    yield conv, block, entry, exit_, edits, cost, [r[0] for r in rows], [ROLES[s] if s else roles[i] for i, s in out], [texts[i] if i >= 0 else "" for i, _ in out]

        yield from _batches(run(), WALK)

    return both.select("conv_id", "block", "roles", "texts", "faults", "after", "last", "first").mapInArrow(walked, WALK_SQL)


def _folded(walked: DataFrame, fold: Callable[[int | None, Iterator[tuple]], Iterator[tuple]], schema: list[tuple[str, pa.DataType]], sql: str) -> DataFrame:
    """What fold makes of each conversation's walks that meet, in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(own: Iterator[tuple]) -> Iterator[tuple]:
            state, done = START, None
            for row in own:
                if row[1] != done and row[2] == state:
                    state, done = row[3], row[1]
                    yield row

        yield from _batches((out for conv, own in groupby(streamed(batches), lambda r: r[0]) for out in fold(conv, met(own))), schema)

    return walked.repartition("conv_id").sortWithinPartitions("conv_id", "block", "entry").mapInArrow(run, sql)


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of every repaired row; a conversation whose rows are all deleted has none."""

    def each(conv: int | None, own: Iterator[tuple]) -> Iterator[tuple]:
        place = 0
        for row in own:
            for role, text in zip(row[7], row[8]):
                yield conv, place, role, text
                place += 1

    schema = [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    return _folded(walks(with_faults(conversations)), each, schema, "conv_id long, place long, role string, text string")


def audited(conversations: DataFrame) -> DataFrame:
    """Of each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Null roles and texts count as a space, a null conv_id is a conversation, null turns come first and are in no gap. No
    rows give no rows. Initials other than s, u and a, and empty roles, can't be kept.
    """
    faulty = written(with_faults(conversations), "turn-faults")
    is_ = lambda f: F.count_if(F.col("fault") == f)
    distinct = F.count_distinct("turn")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - distinct, F.lit(0))
    counts = faulty.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), is_(BLANK).alias("blank"), is_(DUPLICATE).alias("duplicate"), is_(CUT).alias("truncated"))

    def digest(conv: int | None, own: Iterator[tuple]) -> Iterator[tuple]:
        sha, edits, cost, illegal, last, begun = hashlib.sha256(), [], 0, 0, None, False
        for row in own:
            edits.append(row[4])
            cost += row[5]
            for initial in row[6]:
                illegal += last is not None and last + initial not in LEGAL
                last = initial
            for role, text in zip(row[7], row[8]):
                sha.update(("\n" * begun + role + ":" + text).encode())
                begun = True
        yield conv, illegal, cost, "".join(edits), sha.hexdigest()

    schema = [("conv", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    repairs = _folded(walks(faulty), digest, schema, "conv long, illegal long, cost long, audit string, repaired_sha256 string")
    return counts.join(repairs, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows harmed by the crc32 of conv_id and turn, modulo 20: 0 drops, 1 empties, 2 takes stops out, 3 repeats, 4 makes a user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    own = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies))).drop("col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of every conversation after damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = audited(damaged(rows)).withColumnRenamed("conv_id", "conv")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
