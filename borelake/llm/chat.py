"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant
messages in turn, user first and assistant last.  A dynamic programme over the
states of that automaton reads the turns in order and chooses for each a role and
one of three ways: a message of its own, a merge with the message before (MERGE),
or a message after an empty one that is inserted (INSERT); another role than the
turn's costs RELABEL, or UNKNOWN if the turn's role is none of the three.  The
cheapest sequence is rendered turn by turn: the pieces of a conversation, in order
of turn, are its text.

All turns are sorted by conversation and turn over ranges, so neither a long
conversation nor many turns of one number, or of none, are one task.  Each range
is cut into blocks of turns.  A block's least costs between all states are a small
matrix; matrices of a conversation are multiplied in order to find the costs with
which each block begins.  With these, each block says for every state at its end in
which state it then began; going back through these answers gives the states at
block borders, and each block is repaired by itself.  Only a row of a few numbers
for each block of a conversation meets in one task.

Defined results: null or other roles, in any case or with white space around, are
read as above or as unknown; a null text is empty; turns of equal number are in the
order of role, of the text's first 64 characters and of its hash; null turns come
first; rows without conv_id are one conversation; of equally cheap repairs the one
taken goes back from the end through the smallest states (system, user, assistant),
however turns are cut into blocks; no rows give no rows; further columns are
ignored; marks of the format in texts are broken by a space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.llm.buckets import whole_groups
from borelake.shared import stored

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
BLOCK = 512
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {BEGIN: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>"


def _ways() -> tuple[np.ndarray, np.ndarray]:
    """Costs from state to state of a turn of each role (3: unknown), and the state of the message inserted on the way (-1: none, -2: a merge)."""
    costs, between = np.full((4, 4, 4), np.inf), np.full((4, 4), -1)
    for a in range(4):
        for b in range(1, 4):
            middle = [m for m in _NEXT[a] if b in _NEXT[m]]
            if a == b:
                own, between[a, b] = MERGE, -2
            elif b in _NEXT[a]:
                own = 0
            elif middle:
                own, between[a, b] = INSERT, middle[0]
            else:
                continue
            for role in range(4):
                costs[role, a, b] = own + (UNKNOWN if role == 3 else 0 if role == b - 1 else RELABEL)
    return costs, between


COSTS, BETWEEN = _ways()
#: What the end costs in each state: the messages that are still missing.
END = np.array([np.inf, 2 * INSERT, INSERT, 0])


def role_number(role):
    clean = F.lower(F.trim(role))
    return F.coalesce(*(F.when(clean == r, k) for k, r in enumerate(ROLES)), F.lit(3))


def matrix(roles: list[int]) -> np.ndarray:
    """Least costs of a block's turns between all states."""
    total = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for role in roles:
        total = (total[:, :, None] + COSTS[role][None]).min(axis=1)
    return total


def steps(roles: list[int], reached: np.ndarray) -> list[np.ndarray]:
    """For each turn, from which state each state is reached at least cost (the smallest of them), if the block begins at these costs."""
    from_ = []
    for role in roles:
        step = reached[:, None] + COSTS[role]
        from_.append(step.argmin(axis=0))
        reached = step.min(axis=0)
    return from_


def path(roles: list[int], reached: np.ndarray, leave: int) -> list[int]:
    """States before the first and after each turn of the repair that ends in ``leave``."""
    states = [leave]
    for back in reversed(steps(roles, reached)):
        states.append(int(back[states[-1]]))
    return states[::-1]


def _safe(text: str | None) -> str:
    return (text or "").replace(_OPEN, "< |im_start|>").replace(_CLOSE, "< |im_end|>")


def _empty(state: int) -> str:
    return f"{_OPEN}{ROLES[state - 1]}\n{_CLOSE}\n"


def piece(before: int, state: int, text: str | None, last: bool) -> str:
    """The rendered text of a turn, up to the next."""
    way = int(BETWEEN[before, state])
    if way == -2:
        out = "\n" + _safe(text)
    else:
        out = (f"{_CLOSE}\n" if before != BEGIN else "") + (_empty(way) if way >= 0 else "") + f"{_OPEN}{ROLES[state - 1]}\n{_safe(text)}"
    if last:
        out += f"{_CLOSE}\n"
        while state != ASSISTANT:
            state = _NEXT[state][-1]
            out += _empty(state)
    return out


_CONV, _PLACE = ["none", "conv"], ["range", "block"]
_KEYS = [*_CONV, *_PLACE]
TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("merged", T.BooleanType()),
    T.StructField("relabelled", T.BooleanType()), T.StructField("inserted", T.IntegerType()), T.StructField("cost", T.IntegerType()), T.StructField("piece", T.StringType()),
])
_FOUR = T.ArrayType(T.DoubleType())


def _keyed(**more: T.DataType) -> T.StructType:
    kinds = {"none": T.IntegerType(), "conv": T.LongType(), "range": T.IntegerType(), "block": T.LongType()}
    return T.StructType([T.StructField(k, v) for k, v in (kinds | more).items()])


def _numbered(turns: DataFrame, block: int) -> DataFrame:
    """Turns in order over ranges, with their range, their row in it, and the block of rows."""
    rows = turns.select(
        F.col("conv_id").isNull().cast("int").alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 64).alias("_role"), F.substring("text", 1, 64).alias("_text"), F.xxhash64("text").alias("_hash"),
        F.monotonically_increasing_id().alias("_row"), role_number(F.col("role")).alias("number"), "text",
    )
    order = [*_CONV, "turn", "_role", "_text", "_hash", "_row"]  # equal rows can be in any order, and so can be cut apart
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*_CONV, "turn", "number", "text")
    out = T.StructType([*_keyed(), T.StructField("row", T.LongType()), *dealt.schema.fields[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number = 0, TaskContext.get().partitionId()
        for batch in batches:
            row = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.full(len(row), number, np.int32)), pa.array(row // block), pa.array(row), *batch.columns[2:]], out.names)

    return stored(dealt.mapInArrow(run, out), "turns")


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per turn of ``turns`` (conv_id, turn, role, text): its repaired role, how it got there, its cost, and the piece that renders it.

    ``place`` is the row's place among all, so it orders each conversation.
    """
    rows = _numbered(turns, block)
    numbers = rows.select(*_KEYS, "row", "number")

    def by_block(run, out: T.StructType, source: DataFrame) -> DataFrame:
        return source.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "row").mapInArrow(run, out)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, _KEYS):
            roles = table.column("number").to_numpy()
            least = [matrix(roles[b:e].tolist()).ravel().tolist() for b, e in zip(edges, edges[1:])]
            heads = table.select(_KEYS).take(pa.array(edges[:-1]))
            yield from heads.append_column("least", pa.array(least, pa.list_(pa.float64()))).combine_chunks().to_batches()

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reached = None, np.empty(0)
        for batch in batches:
            begun = []
            for key, least in zip(zip(*(batch.column(c).to_pylist() for c in _CONV), strict=True), batch.column("least").to_pylist(), strict=True):
                if key != at:
                    at, reached = key, np.array([0, np.inf, np.inf, np.inf])
                begun.append(reached.tolist())
                reached = (reached[:, None] + np.array(least).reshape(4, 4)).min(axis=0)
            yield pa.RecordBatch.from_arrays([*batch.select(_KEYS).columns, pa.array(begun, pa.list_(pa.float64()))], [*_KEYS, "reached"])

    least = by_block(multiplied, _keyed(least=_FOUR), numbers)
    begun = stored(least.repartition(*_CONV).sortWithinPartitions(*_KEYS).mapInArrow(forward, _keyed(reached=_FOUR)), "roles")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, _KEYS):
            roles, reached = table.column("number").to_numpy(), table.column("reached").take(pa.array(edges[:-1])).to_pylist()
            entries, ends = [], []
            for b, e, costs in zip(edges, edges[1:], reached, strict=False):
                own = roles[b:e].tolist()
                entries.append([path(own, np.array(costs), leave)[0] for leave in range(4)])
                ends.append((np.array(costs)[:, None] + matrix(own)).min(axis=0).tolist())
            heads = table.select([*_KEYS, "reached"]).take(pa.array(edges[:-1]))
            heads = heads.append_column("entries", pa.array(entries, pa.list_(pa.int32()))).append_column("ends", pa.array(ends, pa.list_(pa.float64())))
            yield from heads.combine_chunks().to_batches()

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, 0
        for batch in batches:
            leave, last = [], []
            for key, entries, ends in zip(zip(*(batch.column(c).to_pylist() for c in _CONV), strict=True), *(batch.column(c).to_pylist() for c in ("entries", "ends")), strict=True):
                last.append(key != at)
                if key != at:
                    at, state = key, int((np.array(ends) + END).argmin())
                leave.append(state)
                state = entries[state]
            yield pa.RecordBatch.from_arrays([*batch.select([*_KEYS, "reached"]).columns, pa.array(leave, pa.int32()), pa.array(last, pa.bool_())], [*_KEYS, "reached", "leave", "last"])

    both = by_block(answered, _keyed(reached=_FOUR, entries=T.ArrayType(T.IntegerType()), ends=_FOUR), numbers.join(begun, _KEYS))
    back = both.repartition(*_CONV).sortWithinPartitions(*_CONV, F.desc("range"), F.desc("block"))
    plan = stored(back.mapInArrow(backward, _keyed(reached=_FOUR, leave=T.IntegerType(), last=T.BooleanType())), "repairs")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, _KEYS):
            roles, texts = table.column("number").to_numpy(), table.column("text").to_pylist()
            heads = table.select(["reached", "leave", "last"]).take(pa.array(edges[:-1])).to_pylist()
            out: dict[str, list] = {k: [] for k in ("role", "merged", "relabelled", "inserted", "cost", "piece")}
            for b, e, head in zip(edges, edges[1:], heads, strict=False):
                states = path(roles[b:e].tolist(), np.array(head["reached"]), head["leave"])
                for k in range(b, e):
                    before, state, end = states[k - b], states[k - b + 1], head["last"] and k == e - 1
                    missing = int(END[state]) if end else 0
                    for name, value in (
                        ("role", ROLES[state - 1]), ("merged", BETWEEN[before, state] == -2), ("relabelled", roles[k] != state - 1),
                        ("inserted", int(BETWEEN[before, state] >= 0) + missing // INSERT), ("cost", int(COSTS[roles[k], before, state]) + missing), ("piece", piece(before, state, texts[k], end)),
                    ):
                        out[name].append(value)
            none = table.column("none").to_numpy() == 1
            place = (table.column("range").to_numpy().astype(np.int64) << 40) + table.column("row").to_numpy()
            columns = [pa.array(table.column("conv").to_numpy(), mask=none), table.column("turn").combine_chunks(), pa.array(place), pa.array(out["role"]), pa.array(out["merged"], pa.bool_()), pa.array(out["relabelled"], pa.bool_()), pa.array(out["inserted"], pa.int32()), pa.array(out["cost"], pa.int32()), pa.array(out["piece"], pa.string())]
            yield from pa.Table.from_arrays(columns, TURNS.names).to_batches()

    return by_block(repaired, TURNS, rows.join(plan, _KEYS))


def conversations(repaired: DataFrame) -> DataFrame:
    """Per conversation of ``repair``'s rows: turns, messages, merges, relabels, insertions, cost and rendered characters; all are sums."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    return repaired.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), (F.count(F.lit(1)) - count("merged") + count("inserted")).alias("n_messages"), count("merged").alias("n_merged"),
        count("relabelled").alias("n_relabelled"), count("inserted").alias("n_inserted"), count("cost").alias("cost"), F.sum(F.char_length("piece")).alias("n_chars"),
    )


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, repaired and rendered."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op9_chat": op9_chat}
SQL: dict = {}
