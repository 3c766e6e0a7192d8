"""Chat formatting by minimum-cost role repair.

A legal conversation is: an optional system turn, then user and assistant in turn, user first, ending
with an assistant turn. Each turn of the input is kept, merged into the turn before it (same role),
relabelled, or preceded by inserted empty turns; a dynamic programme over the automaton's states finds
the repair of least cost (ties: the first in the order below), and the result is rendered.

States after a turn: 0 nothing yet, 1 system, 2 user, 3 assistant. A conversation is cut into chunks of
consecutive turns, so one of any length is never in one task: each chunk is reduced to its 4 x 4 matrix
of least costs, the matrices of a conversation are folded in order to give each chunk its state on
entry, and each chunk then finds and renders its own path. Costs add up, so the result is the same as
that of one programme over the whole conversation.

Defined cases: a null or unknown role is relabelled at no extra charge for the kind of label; null text
is empty; turns sort by turn, then a hash of role and text, then these; a null turn sorts as -1; turns repeated in full are one turn with
a count; a conversation without turns doesn't exist; a null conversation id is a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import by_group, staged, table

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
MERGE, RELABEL, INSERT = 1.0, 4.0, 1.5
#: Turn numbers of a chunk; more rows than CHUNK_ROWS of one chunk are dealt out by their hash, in order.
CHUNK_TURNS, CHUNK_ROWS = 256, 4096
INFINITE = float("inf")
#: Inserted empty turns on the way from a state to a role: legal successors are 0>1, 0>2, 1>2, 2>3, 3>2.
FILL = {(0, 1): (), (0, 2): (), (1, 2): (), (2, 3): (), (3, 2): (), (0, 3): (2,), (1, 3): (2,), (2, 2): (3,), (3, 3): (2,)}
HEADER, FOOTER = "<|{}|>\n", "\n<|end|>\n"


def steps(state: int, role: int):
    """(cost, next state, label, inserted states, merged) of all ways to take a turn of ``role`` (1 to 3, 0 unknown)."""
    for label in (1, 2, 3):
        relabel = RELABEL * (label != role)
        if label == state:
            yield relabel + MERGE, state, label, (), True
        if (fill := FILL.get((state, label))) is not None:
            yield relabel + INSERT * len(fill), label, label, fill, False


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def costs(roles: list[int]) -> list[list[float]]:
    """Least cost of taking all turns, from each state to each state."""
    out = []
    for start in range(4):
        row = [INFINITE] * 4
        row[start] = 0.0
        for role in roles:
            new = [INFINITE] * 4
            for state, cost in enumerate(row):
                if cost < INFINITE:
                    for more, then, *_ in steps(state, role):
                        new[then] = min(new[then], cost + more)
            row = new
        out.append(row)
    return out


def closing(state: int) -> tuple[float, tuple[int, ...]]:
    """Cost and inserted states that end a conversation left in a state."""
    fill = {0: (2, 3), 1: (2, 3), 2: (3,), 3: ()}[state]
    return INSERT * len(fill), fill


def boundaries(chunks: list[list[list[float]]]) -> tuple[list[int], float]:
    """The state on entry to each chunk and at the end, on a path of least cost, and that cost."""
    rows = [[0.0, INFINITE, INFINITE, INFINITE]]
    for m in chunks:
        rows.append([min(rows[-1][s] + m[s][t] for s in range(4)) for t in range(4)])
    ends = [rows[-1][s] + closing(s)[0] for s in range(4)]
    state = min(range(4), key=lambda s: ends[s])
    best, path = ends[state], [state]
    for k in range(len(chunks) - 1, -1, -1):
        state = min(range(4), key=lambda s: rows[k][s] + chunks[k][s][state])
        path.append(state)
    return path[::-1], best


def path(roles: list[int], start: int, end: int) -> list[tuple[int, tuple[int, ...], bool]]:
    """(label, inserted states before, merged) of each turn, on the least path from start to end."""
    layers: list[dict[int, tuple[float, int, tuple]]] = []
    row = {start: 0.0}
    for role in roles:
        new: dict[int, tuple[float, int, tuple]] = {}
        for state in sorted(row):
            for more, then, label, fill, merged in steps(state, role):
                cost = row[state] + more
                if then not in new or cost < new[then][0]:
                    new[then] = cost, state, (label, fill, merged)
        layers.append(new)
        row = {s: c for s, (c, *_) in new.items()}
    out, state = [], end
    for layer in reversed(layers):
        _, state_before, step = layer[state]
        out.append(step)
        state = state_before
    return out[::-1]


def turns(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Distinct turns with a chunk number: (key, chunk, part, turn, role, text, copies)."""
    rows = conversations.select(F.col(key).alias("key"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("copies"))
    return staged(rows.withColumn("chunk", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / CHUNK_TURNS)), "turns")


def repair(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row a turn: (key, chunk, part, n, turn, role, new_role, merged, inserted, text, copies, rendered, cost).

    ``rendered`` texts of a conversation, joined in the order of (chunk, part, n), are the whole.
    """
    rows = turns(conversations, key)
    kind = rows.schema["key"].dataType.simpleString()
    # a chunk of too many rows (many turns of one number) is cut by ranges of role and text's hash
    sizes = rows.groupBy("key", "chunk").count().filter(F.col("count") > CHUNK_ROWS).withColumn("parts", F.ceil(F.col("count") / CHUNK_ROWS)).select(F.col("key").alias("k"), F.col("chunk").alias("c"), "parts")
    rows = rows.withColumn("order", F.pmod(F.xxhash64("role", "text"), F.lit(1 << 30))).join(sizes, F.col("key").eqNullSafe(F.col("k")) & (F.col("chunk") == F.col("c")), "left")
    spread = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.floor((F.coalesce(F.col("turn"), F.lit(-1)) % CHUNK_TURNS) * F.col("parts") + F.col("order") * F.col("parts") / (1 << 30)))
    rows = staged(rows.withColumn("part", spread.cast("long")).drop("k", "c", "parts"), "turn-chunks")
    rows = rows.select("key", "chunk", "part", "turn", "order", "role", "text", "copies")
    sort = ["turn", "order", "role", "text"]

    def matrix(group: list[tuple]) -> list[tuple]:
        return [(*group[0][:3], [x for r in costs([role_number(row[5]) for row in group]) for x in r])]

    matrices = by_group(rows, ["key", "chunk", "part"], sort, matrix, f"key {kind}, chunk long, part long, m array<double>")

    def enter(group: list[tuple]) -> list[tuple]:
        states, cost = boundaries([[row[3][4 * s : 4 * s + 4] for s in range(4)] for row in group])
        return [(*row[:3], states[k], states[k + 1], k + 1 == len(group), cost) for k, row in enumerate(group)]

    # one row of sixteen numbers for each chunk
    entries = by_group(staged(matrices, "turn-costs"), ["key"], ["chunk", "part"], enter, f"k {kind}, c long, p long, first int, last int, ends boolean, cost double")
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("chunk") == F.col("c")) & (F.col("part") == F.col("p"))

    def render(group: list[tuple]) -> list[tuple]:
        before, end, ends, cost = group[0][8:]
        found, out = path([role_number(row[5]) for row in group], before, end), []
        for n, ((label, fill, merged), row) in enumerate(zip(found, group)):
            head = "\n" if merged else (FOOTER if before else "") + "".join(HEADER.format(ROLES[s - 1]) + FOOTER for s in fill) + HEADER.format(ROLES[label - 1])
            tail = FOOTER + "".join(HEADER.format(ROLES[s - 1]) + FOOTER for s in closing(label)[1]) if ends and n + 1 == len(group) else ""
            out.append((*row[:3], n, row[3], row[5], ROLES[label - 1], merged, len(fill), row[6], row[7], head + row[6] + tail, cost))
            before = label
        return out

    joined = rows.join(entries, same).drop("k", "c", "p")
    turn_kind = rows.schema["turn"].dataType.simpleString()
    return by_group(joined, ["key", "chunk", "part"], sort, render, f"key {kind}, chunk long, part long, n int, turn {turn_kind}, role string, new_role string, merged boolean, inserted int, text string, copies long, rendered string, cost double")


def op7_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair(table(spark, sf_dir, "conversations"))
    return found.select(F.col("key").alias("conv_id"), "chunk", "part", "n", "turn", "role", "new_role", "merged", "inserted", "copies", "rendered", "cost")


QUERIES = {"op7_chat_role_repair": op7_chat_role_repair}
ORACLE_SQL: dict[str, str] = {}
