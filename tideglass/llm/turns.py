"""Repair of conversation structure by the cheapest edits, as a dynamic programme over time-major tensors.

A repaired conversation is empty, or one system turn at most and then pairs of a user's
and an assistant's turn. Rows are kept (0), given another role (1), deleted (2, a must
for blank and duplicate rows) or preceded by inserted empty turns (5 each); a truncated
row that stays costs 5 more.

What has been put out so far is one of four states. Conversations of about one length
are a tensor: going back in time, one step updates the costs of all states of all of
them, and the costs are stored; going forward, one step picks for all of them the first
letter, in ASCII order, that keeps to the least cost. Inserted turns and new roles
follow from the state, so that letters name the repair.

Most conversations go whole to one task, which streams over its sorted rows. Those of
more than ``MOST_ROWS`` rows are cut into chunks: a chunk gives a matrix of least costs
from state to state, these are combined from the last chunk to the first, and every
chunk is then traced by itself from the state in which the one before ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import map_slices, written
from tideglass.shared import discard, materialise

RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A longer conversation is cut into chunks; where more than ``MOST_LONG`` could be as long, the bound rises to the share that so few can hold.
MOST_ROWS, MOST_LONG = 4096, 50_000
CHUNK = 1024
#: Rows, and characters of text, that a task repairs together.
ROWS_AT_ONCE, CHARACTERS_AT_ONCE = 20_000, 8_000_000
#: Cells of a tensor of costs.
CELLS = 1_000_000

_SPACE = " \t\n\v\f\r"
#: States: nothing put out, a system turn, a user's, an assistant's. ``_ROLE`` is the next turn by state, ``_TO`` the state after it.
_TO = np.array([2, 2, 3, 2])
_ROLE = ("user", "user", "assistant", "user")
#: The state after keeping a row, by state and its role's initial (s, u, a, other); -1 is not allowed.
_KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_INITIALS = {"s": 0, "u": 1, "a": 2}
_FAR = np.int64(1) << 40
#: Costs of coming to an end: a user's turn wants an assistant's, a system turn both.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
GOOD, BLANK, DUPLICATE, CUT = range(4)
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped) after the damage that crc32 of ``conv_id:turn`` modulo 20 deals.

    0 drops a row (it stays, marked), 1 empties its text, 2 takes ``.!?`` away, 3
    repeats it, 4 sets the role user. A null is one space where a string is needed.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn))) % 20
    kept = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), h.alias("h"))
    new_text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = kept.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), (F.col("h") == 0).alias("dropped"), "h")
    times = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return changed.withColumn("_time", times).drop("h", "_time")


def backward(initial: np.ndarray, kind: np.ndarray, length: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Least costs [time, conversation, state, ...] from before each row on; ``after`` [conversation, state, ...] are those behind the last row.

    ``initial`` and ``kind`` are [time, conversation]; rows from a conversation's ``length`` on are padding.
    """
    steps = len(initial)
    costs = np.empty((steps + 1, *after.shape), np.int64)
    costs[steps] = after
    wide = (...,) + (None,) * (after.ndim - 1)
    for t in range(steps - 1, -1, -1):
        later = costs[t + 1]
        stays = np.where(kind[t] == CUT, TRUNCATED, np.where(kind[t] == GOOD, 0, _FAR))[wide]
        here = np.minimum(later + DELETE, later[:, _TO] + RELABEL + stays)
        to = _KEEP[:, initial[t]].T
        kept = np.take_along_axis(later, np.maximum(to, 0).reshape(to.shape + (1,) * (after.ndim - 2)), 1)
        here = np.minimum(here, np.where((to >= 0).reshape(to.shape + (1,) * (after.ndim - 2)), kept + stays, _FAR))
        for _ in range(3):
            here = np.minimum(here, here[:, _TO] + INSERT)
        costs[t] = np.where((t < length)[wide], np.minimum(here, _FAR), later)
    return costs


def forward(initial: np.ndarray, kind: np.ndarray, length: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters [conversation, time, 4], state in the end) of the cheapest edits from ``state``, ASCII-least among them; 0 is no letter.

    Before its own letter, a row has up to three inserted turns. ``last`` says
    where the conversation ends and closing turns are inserted.
    """
    steps, n = initial.shape
    letters, every, state = np.zeros((n, steps + 1, 4), np.uint8), np.arange(n), state.copy()
    for t in range(steps):
        todo = t < length
        stays = np.where(kind[t] == CUT, TRUNCATED, 0)
        may_stay = (kind[t] == GOOD) | (kind[t] == CUT)
        for slot in range(4):
            here, later = costs[t][every, state], costs[t + 1]
            to, new = _KEEP[state, initial[t]], _TO[state]
            drop = todo & (later[every, state] + DELETE == here)
            more = todo & ~drop & (costs[t][every, new] + INSERT == here)
            keep = todo & ~drop & ~more & may_stay & (to >= 0) & (later[every, np.maximum(to, 0)] + stays == here)
            relabel = todo & ~drop & ~more & ~keep
            letters[drop, t, 3], letters[keep, t, 3], letters[relabel, t, 3] = ord("D"), ord("K"), ord("R")
            if slot < 3:
                letters[more, t, slot] = ord("I")
            state = np.where(keep, to, np.where(more | relabel, new, state))
            todo = more
            if not todo.any():
                break
    for slot in range(2):
        more = last & (END[state] > 0)
        letters[more, steps, slot] = ord("I")
        state = np.where(more, _TO[state], state)
    return letters, state


class Part:
    """A conversation, or a chunk of one: roles and texts in order, and the kind of each row."""

    def __init__(self, roles: list[str], texts: list[str], repeated: list[bool] | None = None):
        self.roles, self.texts = roles, texts
        seen: set[tuple[str, str]] = set()
        self.kinds = []
        for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
            words = text.strip(_SPACE)
            again = (role, text) in seen if repeated is None else repeated[k]
            self.kinds.append(BLANK if not words else DUPLICATE if again else GOOD if words[-1] in ".!?" else CUT)
            if repeated is None:
                seen.add((role, text))
        self.initials = [_INITIALS.get(r[:1], 3) for r in roles]

    def illegal(self) -> int:
        """Neighbours other than system and user, user and assistant, assistant and user."""
        return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(self.initials, self.initials[1:], strict=False))

    def text(self, letters: str, state: int) -> list[str]:
        """The repaired turns as ``role:text``, from a state on."""
        out, at = [], 0
        for x in letters:
            if x == "I":
                out.append(f"{_ROLE[state]}:")
                state = int(_TO[state])
                continue
            if x == "K":
                out.append(f"{self.roles[at]}:{self.texts[at]}")
                state = int(_KEEP[state, self.initials[at]])
            elif x == "R":
                out.append(f"{_ROLE[state]}:{self.texts[at]}")
                state = int(_TO[state])
            at += 1
        return out


def buckets(parts: list[Part]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(places, initials, kinds, lengths) of parts of about one length: time-major tensors, padded at the end."""
    by: dict[int, list[int]] = {}
    for k, p in enumerate(parts):
        by.setdefault(len(p.roles).bit_length(), []).append(k)
    for bits, places in sorted(by.items()):
        together = max(1, CELLS >> bits)
        for k in range(0, len(places), together):
            at = places[k : k + together]
            length = np.array([len(parts[i].roles) for i in at])
            initial, kind = (np.zeros((int(length.max()), len(at)), np.int64) for _ in range(2))
            for c, i in enumerate(at):
                initial[: length[c], c], kind[: length[c], c] = parts[i].initials, parts[i].kinds
            yield at, initial, kind, length


def traced(parts: list[Part], after: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(letters, least cost, state in the end) of each part, given the costs behind it and the state before it."""
    audit, cost, state = [""] * len(parts), np.zeros(len(parts), np.int64), start.copy()
    for at, initial, kind, length in buckets(parts):
        costs = backward(initial, kind, length, after[at])
        letters, state[at] = forward(initial, kind, length, costs, start[at], last[at])
        cost[at] = costs[0][np.arange(len(at)), start[at]]
        for i, row in zip(at, letters.reshape(len(at), -1), strict=True):
            audit[i] = row[row > 0].tobytes().decode()
    return audit, cost, state


def _whole(kind: str):
    """A task's work on sorted rows (conv_id, turn, role, text, dropped) of whole conversations."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, turns, parts, size = [], [], [], [0, 0]
        current: list = []

        def close() -> None:
            names.append(current[0])
            turns.append(current[1])
            parts.append(Part(current[2], current[3]))

        def done() -> pa.RecordBatch:
            n = len(parts)
            audit, cost, _ = traced(parts, np.tile(END, (n, 1)), np.zeros(n, np.int64), np.ones(n, bool))
            of = lambda k: [p.kinds.count(k) for p in parts]
            gaps = [max(t) - min(t) + 1 - len(t) if t else 0 for t in turns]
            numbers = [gaps, of(BLANK), of(DUPLICATE), of(CUT), [p.illegal() for p in parts], cost]
            text = ["\n".join(p.text(a, 0)) for p, a in zip(parts, audit, strict=True)]
            out = pa.record_batch([pa.array(names, kind), *[pa.array(x, pa.int64()) for x in numbers], pa.array(audit, pa.string()), pa.array(text, pa.string())], names=["conv_id", *FACTS, "audit", "repaired"])
            for x in (names, turns, parts):
                x.clear()
            size[:] = [0, 0]
            return out

        for batch in batches:
            for conv, turn, role, text, dropped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not current or conv != current[0]:
                    if current:
                        close()
                        if size[0] >= ROWS_AT_ONCE or size[1] >= CHARACTERS_AT_ONCE:
                            yield done()
                    current = [conv, set(), [], []]
                if not dropped:
                    if turn is not None:
                        current[1].add(turn)
                    current[2].append(role)
                    current[3].append(text)
                    size[0] += 1
                    size[1] += len(text)
        if current:
            close()
            yield done()

    return work


def _parts(batch: pa.RecordBatch) -> list[Part]:
    """The chunks of a batch with a column ``rows``."""
    return [Part([x["role"] for x in rows], [x["text"] for x in rows], [x["again"] for x in rows]) for rows in batch.column("rows").to_pylist()]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: what is counted, its first and last initial, and the least cost from state to state."""
    reach = np.where(np.eye(4, dtype=bool), np.int64(0), _FAR)
    for batch in batches:
        parts = _parts(batch)
        costs: list = [None] * len(parts)
        for at, initial, kind, length in buckets(parts):
            first = backward(initial, kind, length, np.tile(reach, (len(at), 1, 1)))[0]
            for i, m in zip(at, first, strict=True):
                costs[i] = m.ravel().tolist()
        of = lambda k: pa.array([p.kinds.count(k) for p in parts], pa.int64())
        ends = [pa.array([p.initials[k] for p in parts], pa.int32()) for k in (0, -1)]
        yield pa.record_batch([batch.column("group"), batch.column("chunk"), of(BLANK), of(DUPLICATE), of(CUT), pa.array([p.illegal() for p in parts], pa.int64()), *ends, pa.array(costs, pa.list_(pa.int64()))], names=["group", "chunk", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs"])


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk of a long conversation: the least costs behind it, and of the first one those before it."""
    for batch in batches:
        for group, chunks in zip(batch.column("group").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
            costs, after = END, []
            for x in reversed(chunks):
                after.append(costs.tolist())
                costs = (np.array(x["costs"], np.int64).reshape(4, 4) + costs[None, :]).min(1)
            n = len(chunks)
            yield pa.record_batch([pa.array([group] * n), pa.array([x["chunk"] for x in chunks]), pa.array(after[::-1], pa.list_(pa.int64())), pa.array([k == n - 1 for k in range(n)]), pa.array([int(costs[0])] * n)], names=["group", "chunk", "after", "ends", "cost"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each chunk ends, by the state before it."""
    for batch in batches:
        parts, after, last = _parts(batch), np.array(batch.column("after").to_pylist(), np.int64), batch.column("ends").to_numpy(zero_copy_only=False)
        to = [traced(parts, after, np.full(len(parts), s), last)[2] for s in range(4)]
        yield pa.record_batch([batch.column("group"), batch.column("chunk"), pa.array(np.stack(to, 1).tolist(), pa.list_(pa.int64()))], names=["group", "chunk", "to"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each chunk of a long conversation."""
    for batch in batches:
        for group, chunks in zip(batch.column("group").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
            state, start = 0, []
            for x in chunks:
                start.append(state)
                state = x["to"][state]
            yield pa.record_batch([pa.array([group] * len(chunks)), pa.array([x["chunk"] for x in chunks]), pa.array(start, pa.int64())], names=["group", "chunk", "start"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters and the repaired turns of each chunk."""
    for batch in batches:
        parts, after = _parts(batch), np.array(batch.column("after").to_pylist(), np.int64)
        start, last = batch.column("start").to_numpy(), batch.column("ends").to_numpy(zero_copy_only=False)
        audit, _, _ = traced(parts, after, start, last)
        text = [t if (t := p.text(a, s)) else None for p, a, s in zip(parts, audit, start.tolist(), strict=True)]
        yield pa.record_batch([batch.column("group"), batch.column("chunk"), pa.array(audit, pa.string()), pa.array([t and "\n".join(t) for t in text], pa.string())], names=["group", "chunk", "audit", "piece"])


def _long(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The repair of the conversations ``ids`` (group, conv_id), in chunks of their rows in order."""
    order = [F.asc_nulls_first("turn"), "role", "text"]
    # rows that are alike are dealt by where they are read
    own = rows.where("not dropped").join(F.broadcast(ids.withColumnRenamed("conv_id", "_id")), F.col("conv_id").eqNullSafe(F.col("_id"))).select("group", "turn", "role", "text", F.monotonically_increasing_id().alias("at"))
    ranged = own.repartitionByRange("group", *order, "at").sortWithinPartitions("group", *order, "at").select("group", "turn", "role", "text", F.monotonically_increasing_id().alias("seq"))
    table = materialise(ranged, "turns_long")
    digest = F.sha2(F.concat("role", F.lit("\0"), "text"), 256)
    first = table.groupBy("group", digest.alias("digest")).agg(F.min("seq").alias("seq")).select("seq", F.lit(False).alias("again"))
    marked = table.join(first, "seq", "left").select("group", F.floor(F.col("seq") / CHUNK).alias("chunk"), F.struct("seq", "role", "text", F.coalesce("again", F.lit(True)).alias("again")).alias("row"))
    chunks = written(marked.groupBy("group", "chunk").agg(F.sort_array(F.collect_list("row")).alias("rows")), "turns_chunks")

    def by_group(df: DataFrame, *columns: str) -> DataFrame:
        return df.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("chunk", *columns))).alias("chunks"))

    few = lambda df, f, schema, name: written(map_slices(df, f, schema, rows=4), name, 4)
    facts = few(chunks, _matrices, "group long, chunk long, blank long, duplicate long, truncated long, illegal long, first int, last int, costs array<long>", "turns_matrices")
    behind = few(by_group(facts, "costs"), _behind, "group long, chunk long, after array<long>, ends boolean, cost long", "turns_behind")
    keys = ["group", "chunk"]
    ready = chunks.join(behind, keys)
    ends = few(ready.select(*keys, "rows", "after", "ends"), _ends, "group long, chunk long, to array<long>", "turns_ends")
    starts = few(by_group(ends, "to"), _starts, "group long, chunk long, start long", "turns_starts")
    pieces = few(ready.join(starts, keys).select(*keys, "rows", "after", "ends", "start"), _pieces, "group long, chunk long, audit string, piece string", "turns_pieces")
    joined = by_group(pieces, "audit", "piece").select("group", F.array_join(F.transform("chunks", lambda x: x["audit"]), "").alias("audit"), F.array_join(F.transform("chunks", lambda x: x["piece"]), "\n").alias("repaired"))
    before = F.lag("last").over(Window.partitionBy("group").orderBy("chunk"))
    seam = (before.isNotNull() & ~((before == 0) & (F.col("first") == 1) | (before == 1) & (F.col("first") == 2) | (before == 2) & (F.col("first") == 1))).cast("long")
    counted = facts.withColumn("seam", seam).groupBy("group").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.col("seam")).alias("illegal"))
    turns = table.where("turn is not null").groupBy("group", "turn").agg(F.lit(1).alias("one")).groupBy("group").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    cost = behind.groupBy("group").agg(F.max("cost").alias("cost"))
    found = ids.join(turns, "group", "left").join(counted, "group", "left").join(cost, "group", "left").join(joined, "group", "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in FACTS]
    result = materialise(found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired", F.lit("")).alias("repaired")), "turns_repaired")
    discard(table, chunks, facts, behind, ends, starts, pieces)
    return result


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text, dropped): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired.

    Rows go by turn, nulls first, then by role and text. ``gaps`` are missing turn
    numbers; each row counts as the first of blank, duplicate (role and text stood
    before) or truncated that it is; ``illegal`` counts neighbours that may not
    follow each other; ``audit`` has the letters of the edits (Keep, Rerole, Delete, Insert)
    and ``repaired`` the turns as ``role:text`` lines. A null id is a conversation
    like others, null roles and texts are one space, a role that starts with none
    of s, u, a cannot be kept. A conversation of dropped rows only has zeros and
    empty strings. An empty table gives an empty result; other columns play no part.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", "turn", blank("role"), blank("text"), "dropped")
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    # so many conversations at most can be as long
    ids = materialise(counts.where(F.col("n") > max(MOST_ROWS, total // MOST_LONG)).select("conv_id", F.monotonically_increasing_id().alias("group")), "turns_ids")
    some = ids.limit(1).count() > 0
    short = rows.join(F.broadcast(ids.select(F.col("conv_id").alias("_id"))), F.col("conv_id").eqNullSafe(F.col("_id")), "left_anti") if some else rows
    ordered = short.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    field = rows.schema["conv_id"].dataType
    schema = f"conv_id {field.simpleString()}, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string, repaired string"
    found = map_slices(ordered, _whole(_arrow(field)), schema)
    return found.unionByName(_long(rows, ids)) if some else found


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
