"""Structure repair of conversations: cheapest edits, and the least of the cheapest audits.

An audit is the string of the edits' initials: D(elete), I(nsert), K(eep), R(erole), one
letter after the other; only I does not use up a row. Repaired roles read s?(ua)+ or
nothing, which is an automaton of four states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from tracegraph.llm.ranks import ranked
from tracegraph.llm.tables import quoted, saved
from tracegraph.operators.shared import salted_join

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# States after the roles so far: none, s, ...u, ...a.
START, SYSTEM, USER, ASSISTANT = range(4)
# Where an inserted row, or one of a new role, leads.
ONWARD = np.array([USER, USER, ASSISTANT, USER])
# What it costs to end in a state: only START and ASSISTANT may.
ENDING = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
NEVER = 1 << 60
LETTERS = "DIKR"
ROLES = {USER: "user", ASSISTANT: "assistant"}
# A row's kind: its role's initial (s, u, a, other) and its fault.
SOUND, CUT_SHORT, BLANK, DUPLICATE = range(4)
KINDS = 16
# Rows of a conversation that one step looks at together, and blocks under one node above.
BLOCK = 1024
FAN_OUT = 1024
# Rows whose arrays are in memory at once.
ROWS_AT_ONCE = 1 << 16


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """Next state (-1: none) and cost by kind, letter and state, for the letters that use up a row."""
    to = np.full((KINDS, 4, 4), -1)
    cost = np.zeros((KINDS, 4, 4), dtype=np.int64)
    keeps = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
    for kind in range(KINDS):
        fault = kind // 4
        extra = TRUNCATED if fault == CUT_SHORT else 0
        for state in range(4):
            to[kind, 0, state], cost[kind, 0, state] = state, DELETE
            if fault in (SOUND, CUT_SHORT):
                to[kind, 2, state], cost[kind, 2, state] = keeps[kind % 4].get(state, -1), KEEP + extra
                to[kind, 3, state], cost[kind, 3, state] = ONWARD[state], REROLE + extra
    return to, cost


TO, COST = _moves()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheapest ways through a, then b: (min, +) products of 4 x 4 matrices."""
    out = np.full(np.broadcast_shapes(a.shape, b.shape), NEVER, dtype=np.int64)
    for m in range(4):
        np.minimum(out, a[..., :, m, None] + b[..., None, m, :], out=out)
    return out


def _steps() -> np.ndarray:
    """By kind: costs from state to state over insertions before a row and the row itself."""
    insert = np.full((4, 4), NEVER, dtype=np.int64)
    np.fill_diagonal(insert, 0)
    insert[range(4), ONWARD] = INSERT
    out = np.full((KINDS, 4, 4), NEVER, dtype=np.int64)
    for kind in range(KINDS):
        for letter in (0, 2, 3):
            for state in range(4):
                if (to := TO[kind, letter, state]) >= 0:
                    out[kind, state, to] = min(out[kind, state, to], COST[kind, letter, state])
    return product(product(insert, insert), out)


STEPS = _steps()
IDENTITY = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)


def transfer(blocks: list[np.ndarray]) -> np.ndarray:
    """A matrix for each block of kinds: cheapest cost from every state before it to every state after it."""
    sizes = np.array([len(b) for b in blocks])
    order = np.argsort(-sizes, kind="stable")
    out = np.repeat(IDENTITY[None], len(blocks), axis=0)
    for back in range(1, int(sizes.max(initial=0)) + 1):
        live = order[: np.searchsorted(-sizes[order], -back, side="right")]
        kinds = np.array([blocks[i][-back] for i in live])
        out[live] = product(STEPS[kinds], out[live])
    return out


class Paths:
    """Optimal-arc nodes (place, state) of blocks, ranked by their least audit, with doubled pointers.

    ``after`` has the cheapest cost to the end of the conversation from every state behind
    a block; ``last`` marks blocks at whose end rows may still be inserted.
    """

    def __init__(self, blocks: list[np.ndarray], after: np.ndarray, last: np.ndarray):
        sizes = np.array([len(b) for b in blocks])
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        kinds = np.concatenate(blocks)
        left = self._costs(blocks, sizes, after)
        target = np.full((len(left), 4, 4), -1)
        rows = np.delete(np.arange(len(left)), self.ends)
        for letter in (0, 2, 3):
            to = TO[kinds, letter]
            cost = COST[kinds, letter] + np.take_along_axis(left[rows + 1], np.maximum(to, 0), axis=1)
            tight = (to >= 0) & (cost == left[rows])
            target[rows, :, letter] = np.where(tight, (rows[:, None] + 1) * 4 + to, -1)
        spots = np.concatenate([rows, self.ends[last]])
        tight = INSERT + left[spots][:, ONWARD] == left[spots]
        target[spots, :, 1] = np.where(tight, spots[:, None] * 4 + ONWARD, -1)
        self._rank(target.reshape(-1, 4))
        self.cost = left[self.starts]

    @staticmethod
    def _costs(blocks: list[np.ndarray], sizes: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Cheapest cost to the end from every node, block by block from the back."""
        ends = np.cumsum(sizes + 1) - 1
        left = np.full((int(ends[-1]) + 1, 4), NEVER, dtype=np.int64)
        left[ends] = after
        order = np.argsort(-sizes, kind="stable")
        for back in range(1, int(sizes.max()) + 1):
            live = order[: np.searchsorted(-sizes[order], -back, side="right")]
            kinds = np.array([blocks[i][-back] for i in live])
            at = ends[live] - back
            left[at] = np.minimum((STEPS[kinds] + left[at + 1][:, None, :]).min(axis=2), NEVER)
        return left

    def _rank(self, target: np.ndarray) -> None:
        """Ranks by the first 1, 2, 4, ... letters of the nodes' least audits.

        No two arcs of a node share a letter, so the first letters already settle where a
        node's least path goes, and a pointer over twice as many letters is the pointer
        applied twice. The ranks over the whole audits then choose among a node's arcs by
        (letter, rank of the target); the end ranks before every letter.
        """
        nodes = np.arange(len(target))
        open_ = target >= 0
        going = open_.any(axis=1)
        first = open_.argmax(axis=1)
        pointer = np.where(going, target[nodes, first], nodes)
        rank, steps = np.where(going, first + 1, 0), going.astype(np.int64)
        self.pointers = [pointer]
        while (pointer != pointer[pointer]).any():
            steps = steps + steps[pointer]
            rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
            pointer = pointer[pointer]
            self.pointers.append(pointer)
        worst = len(target) + 1
        keys = np.where(open_, np.arange(4) * worst + rank[target], 4 * worst)
        self.letter = np.where(going, keys.argmin(axis=1), -1)
        self.steps, self.last = steps, pointer

    def exits(self) -> np.ndarray:
        """By block and state before it: the state behind it on the least path."""
        return self.last[self.starts[:, None] * 4 + np.arange(4)] % 4

    def walk(self, entry: np.ndarray) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """For each block: row places, letters and next states along the least path from a state."""
        begin = self.starts * 4 + entry
        sizes = self.steps[begin]
        node = np.repeat(begin, sizes)
        after = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for k, pointer in enumerate(self.pointers):
            node = np.where(after >> k & 1, pointer[node], node)
        places, letters, states = node // 4, self.letter[node], self.pointers[0][node] % 4
        at = 0
        for start, size in zip(self.starts.tolist(), sizes.tolist()):
            part = slice(at, at + size)
            yield (places[part] - start).tolist(), letters[part].tolist(), states[part].tolist()
            at += size


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches with at most about ROWS_AT_ONCE rows of conversations."""
    for batch in batches:
        kinds = [np.array(k, dtype=np.int64) for k in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        at, rows = 0, 0
        for i, k in enumerate(kinds):
            rows += len(k)
            if rows >= ROWS_AT_ONCE or i + 1 == len(kinds):
                yield batch.slice(at, i + 1 - at), kinds[at : i + 1]
                at, rows = i + 1, 0


def exclusive_scan(df: DataFrame, combine: Callable, identity: list[int], fan_out: int = FAN_OUT) -> DataFrame:
    """(conv, idx, before): what the values of a conversation's earlier rows combine to.

    ``df`` has conv, idx (gapless) and value (array<long>); ``combine(earlier, value)`` is
    associative. Rows are combined in groups of ``fan_out``, these again, until a
    conversation has one group; then the way down hands every group what lies before it.
    """

    def running(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                acc, out = row.get("before") or identity, []
                for member in row["members"]:
                    out.append((member["idx"], acc))
                    acc = combine(acc, member["value"])
                if whole:
                    out = [(row["up"], acc)]
                conv = pa.array([row["conv"]] * len(out), type=pa.string())
                yield pa.RecordBatch.from_arrays([conv, pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64()))], ["conv", "idx", "value"])

    def grouped(level: DataFrame) -> DataFrame:
        up = F.floor(F.col("idx") / fan_out).alias("up")
        return level.groupBy("conv", up).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("members"))

    schema = "conv string, idx long, value array<long>"
    levels = [df.select("conv", "idx", "value")]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) >= fan_out:
        levels.append(saved(grouped(levels[-1]).mapInArrow(lambda b: running(b, True), schema), "totals"))
    before = None
    for level in reversed(levels):
        groups = grouped(level)
        if before is not None:
            groups = groups.join(before.select("conv", F.col("idx").alias("up"), F.col("value").alias("before")), ["conv", "up"])
        before = saved(groups.mapInArrow(lambda b: running(b, False), schema), "before")
    return before.withColumnRenamed("value", "before")


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("+"), conv.cast("string")), F.lit(""))


def damage(rows: DataFrame) -> DataFrame:
    """The damaged rows of a table with conv_id, turn, role and text; the damage follows from crc32 of ``conv_id:turn``."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    spot = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    kind = F.crc32(spot.cast("binary")) % 20
    drawn = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    broken = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return drawn.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), broken.alias("text"), copies.alias("_copy")
    ).drop("_copy")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with conv (a key without nulls), part and at: their order is (part, at).

    Rows are cut into ranges of (conversation, turn, role, text) at sampled splitters and
    sorted there, so a conversation with a third of all rows spreads over a third of the
    ranges. Nulls of turn come first; rows of one turn follow by role and text.
    """
    keyed = rows.select(_key(F.col("conv_id")).alias("conv"), "conv_id", "turn", "role", "text")
    keyed = keyed.withColumns({"_front": F.substring("text", 1, 32), "_text": F.sha2(F.col("text").cast("binary"), 256), "_row": F.monotonically_increasing_id()})
    order = ["conv", "turn", "role", "_front", "_text", "_row"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    solid = F.rtrim("text", F.lit(SPACE))
    initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    dealt = dealt.select(
        "conv", "conv_id", "turn", "role", "text", initial.alias("initial"),
        F.when(F.length(solid) == 0, BLANK).when(F.right(solid, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT_SHORT).alias("fault"),
        F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "_text"), 256)).alias("same"),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = np.empty(batch.num_rows, dtype=np.int64)
            for i, c in enumerate(batch.column(0).to_pylist()):
                conv, at = c, at + 1 if c == conv else 0
                places[i] = at
            parts = pa.array(np.full(batch.num_rows, part, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(places)], [*batch.schema.names, "part", "at"])

    schema = StructType(list(dealt.schema)).add("part", IntegerType()).add("at", LongType())
    return saved(dealt.mapInArrow(number, schema), "ordered")


def _blocks(ordered: DataFrame, block: int) -> DataFrame:
    """Blocks of a conversation's rows: conv, part, first, kinds, and what their rows add up to."""
    rows = ordered.select("conv", "same", "part", "at", "initial", "fault")
    firsts = rows.groupBy("conv", "same").agg(F.min(F.struct("part", "at")).alias("earliest"))
    marked = salted_join(rows, firsts, ["conv", "same"])
    again = (F.col("fault") != BLANK) & (F.struct("part", "at") != F.col("earliest"))
    kind = F.col("initial") + 4 * F.when(again, DUPLICATE).otherwise(F.col("fault"))
    members = F.array_sort(F.collect_list(F.struct("at", kind.cast("int").alias("kind"))))
    grouped = marked.groupBy("conv", "part", (F.floor(F.col("at") / block) * block).alias("first")).agg(members.alias("members"))
    blocks = grouped.select("conv", "part", "first", F.transform("members", lambda m: m["kind"]).alias("kinds"))
    legal = np.zeros((4, 4), dtype=bool)
    legal[[0, 1, 2], [1, 2, 1]] = True

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kinds in chunks(batches, "kinds"):
            faults = [np.bincount(k // 4, minlength=4) for k in kinds]
            illegal = [int((~legal[k[:-1] % 4, k[1:] % 4]).sum()) for k in kinds]
            columns = [[int(f[c]) for f in faults] for c in (CUT_SHORT, BLANK, DUPLICATE)] + [illegal, [int(k[0] % 4) for k in kinds], [int(k[-1] % 4) for k in kinds]]
            matrices = pa.array(transfer(kinds).reshape(len(kinds), 16).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, pa.int64()) for c in columns], matrices], [*part.schema.names, *MEASURES, "value"])

    schema = StructType(list(blocks.schema))
    for name in MEASURES:
        schema = schema.add(name, LongType())
    return saved(blocks.mapInArrow(measure, schema.add("value", ArrayType(LongType()))), "blocks")


MEASURES = ["truncated", "blank", "duplicate", "illegal", "opening", "closing"]


def _through(later: list[int], earlier: list[int]) -> list[int]:
    return product(np.reshape(earlier, (4, 4)), np.reshape(later, (4, 4))).ravel().tolist()


def _onward(before: list[int], block: list[int]) -> list[int]:
    return [block[s] for s in before]


def _placed(blocks: DataFrame, fan_out: int) -> tuple[DataFrame, DataFrame]:
    """Blocks with after, last, entry and leading, and (conv, illegal) of the pairs between blocks.

    A conversation of one block needs nothing else. For the others the blocks' matrices
    are multiplied from the end, which gives the cost behind every block; then their maps
    from entry to exit state are chained from the start, which gives where the path enters.
    """
    sizes = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    counted = blocks.join(sizes, "conv")
    ending = F.array(*[F.lit(int(v)).cast("long") for v in ENDING])
    alone = counted.filter("n = 1").select("conv", "part", "first", "kinds", ending.alias("after"), F.lit(True).alias("last"), F.lit(START).alias("entry"), F.lit(True).alias("leading"))
    many = ranked(counted.filter("n > 1"), "conv", ["part", "first"], "idx")
    many = saved(many, "long")
    if many.isEmpty():
        return alone, many.select("conv", F.col("illegal")).limit(0)
    backwards = many.select("conv", (F.col("n") - 1 - F.col("idx")).alias("idx"), "value")
    behind = exclusive_scan(backwards, _through, IDENTITY.ravel().tolist(), fan_out)
    joined = many.withColumn("back", F.col("n") - 1 - F.col("idx")).join(behind.withColumnRenamed("idx", "back"), ["conv", "back"])
    known = joined.select("conv", "part", "first", "kinds", "idx", F.col("before").alias("matrix"), (F.col("back") == 0).alias("last"))

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kinds in chunks(batches, "kinds"):
            last = np.array(part.column(part.schema.get_field_index("last")).to_pylist())
            matrix = np.array(part.column(part.schema.get_field_index("matrix")).to_pylist(), dtype=np.int64).reshape(-1, 4, 4)
            after = np.minimum((matrix + ENDING).min(axis=2), NEVER)
            found = Paths(kinds, after, last).exits()
            keep = [part.column(part.schema.get_field_index(c)) for c in ("conv", "part", "first", "kinds", "idx")]
            arrays = [pa.array(x.tolist(), pa.list_(pa.int64())) for x in (after, found)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(last), *arrays], ["conv", "part", "first", "kinds", "idx", "last", "after", "value"])

    schema = StructType(list(known.drop("matrix").schema)).add("after", ArrayType(LongType())).add("value", ArrayType(LongType()))
    mapped = saved(known.mapInArrow(exits, schema), "exits")
    entries = exclusive_scan(mapped, _onward, list(range(4)), fan_out)
    placed = mapped.join(entries, ["conv", "idx"]).select(
        "conv", "part", "first", "kinds", "after", "last", F.get("before", F.lit(START)).cast("int").alias("entry"), (F.col("idx") == 0).alias("leading")
    )
    previous = many.select("conv", (F.col("idx") + 1).alias("idx"), "closing")
    pair = F.col("closing") * 4 + F.col("opening")
    between = many.select("conv", "idx", "opening").join(previous, ["conv", "idx"]).filter(~pair.isin(1, 6, 9))
    return alone.unionByName(placed), between.select("conv", F.lit(1).cast("long").alias("illegal"))


def plan_repairs(rows: DataFrame, block: int = BLOCK, fan_out: int = FAN_OUT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in order, the edits of every row, and the figures of every conversation.

    ``rows`` has conv_id, turn, role and text without nulls in the last two. Edits are (conv,
    part, at, letters, roles, cost): the letters up to and with a row's own, for every I and R
    the new role's initial, and for a conversation's first row the cheapest cost. Insertions
    after the last row stand at the place behind it.
    """
    ordered = in_order(rows)
    blocks = _blocks(ordered, block)
    placed, between = _placed(blocks, fan_out)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kinds in chunks(batches, "kinds"):
            column = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names) if n != "kinds"}
            found = Paths(kinds, np.array(column["after"], dtype=np.int64), np.array(column["last"]))
            entry = np.array(column["entry"])
            out = {n: [] for n in ("conv", "part", "at", "letters", "roles", "cost")}
            for b, (places, letters, states) in enumerate(found.walk(entry)):
                cost = int(found.cost[b, entry[b]]) if column["leading"][b] else None
                spelled = {}
                for place, letter, state in zip(places, letters, states):
                    text, roles = spelled.get(place, ("", ""))
                    spelled[place] = text + LETTERS[letter], roles + ("ua"[state - USER] if letter in (1, 3) else "")
                for place, (text, roles) in spelled.items():
                    for name, value in zip(out, (column["conv"][b], column["part"][b], column["first"][b] + place, text, roles, cost)):
                        out[name].append(value)
                    cost = None
            types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    edits = placed.mapInArrow(edit, "conv string, part int, at long, letters string, roles string, cost long")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    zero = F.lit(0).cast("long")
    pairs = between.select("conv", zero.alias("blank"), zero.alias("duplicate"), zero.alias("truncated"), "illegal")
    counts = blocks.select("conv", "blank", "duplicate", "truncated", "illegal").unionByName(pairs).groupBy("conv").agg(*sums)
    turns = ordered.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count("turn").alias("n"))
    gaps = turns.select("conv", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), zero).alias("gaps"))
    return ordered, saved(edits, "edits"), counts.join(gaps, "conv")


def _spelled(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits and rows of each conversation in one task, an edit before its row."""
    none = F.lit(None).cast("string")
    rows = ordered.select("conv", "part", "at", F.lit(1).alias("row"), "role", "text", none.alias("letters"), none.alias("roles"))
    marks = edits.select("conv", "part", "at", F.lit(0).alias("row"), none.alias("role"), none.alias("text"), "letters", "roles")
    return marks.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "part", "at", "row")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """(conv, letters, [(role, text)]) for each edited place, in order."""
    names = {"u": ROLES[USER], "a": ROLES[ASSISTANT]}
    waiting = None

    def made(letters: str, roles: str) -> tuple[list[tuple[str, str]], str | None]:
        given = [names[r] for r in roles]
        inserted = letters.count("I")
        return [(r, "") for r in given[:inserted]], given[inserted] if len(given) > inserted else None

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "row", "role", "text", "letters", "roles")]
        for conv, is_row, role, text, letters, roles in zip(*cols):
            if not is_row:
                if waiting is not None:
                    yield waiting[0], waiting[1], made(*waiting[1:])[0]
                waiting = conv, letters, roles
                continue
            lines, changed = made(*waiting[1:])
            if waiting[1][-1] != "D":
                lines.append((changed or role, text))
            yield conv, waiting[1], lines
            waiting = None
    if waiting is not None:
        yield waiting[0], waiting[1], made(*waiting[1:])[0]


def repaired_rows(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: conv, place (from 0), role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, out = None, 0, []
        for conv, _, lines in _lines(batches):
            if conv != current:
                current, place = conv, 0
            for role, text in lines:
                out.append((conv, place, role, text))
                place += 1
            if len(out) >= 1000:
                yield _batch(out, ["conv", "place", "role", "text"])
                out = []
        if out:
            yield _batch(out, ["conv", "place", "role", "text"])

    return _spelled(ordered, edits).mapInArrow(run, "conv string, place long, role string, text string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if isinstance(c[0], int) else pa.string()) for c in zip(*rows)], names)


def digests(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256). A digest is one chain by definition, so the texts of a
    conversation pass through one task, line by line, never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, audit, digest, begun, out = None, [], None, False, []
        for conv, letters, lines in _lines(batches):
            if conv != current:
                if current is not None:
                    out.append((current, "".join(audit), digest.hexdigest()))
                current, audit, digest, begun = conv, [], hashlib.sha256(), False
            audit.append(letters)
            for role, text in lines:
                digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
            if len(out) >= 1000:
                yield _batch(out, ["conv", "audit", "repaired_sha256"])
                out = []
        if current is not None:
            out.append((current, "".join(audit), digest.hexdigest()))
        if out:
            yield _batch(out, ["conv", "audit", "repaired_sha256"])

    return _spelled(ordered, edits).mapInArrow(run, "conv string, audit string, repaired_sha256 string")


NOTHING = hashlib.sha256(b"").hexdigest()


def repair_report(conversations: DataFrame, block: int = BLOCK, fan_out: int = FAN_OUT) -> DataFrame:
    """One row for every conv_id of the table, of its rows after ``damage``.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256. A null conv_id is a conversation like others; null roles and texts are one
    space, so such rows are blank or have a role that cannot be kept. Null turns come first and
    count for no gap; rows of one turn follow by role and text, equal ones in either order.
    A conversation without rows has zeros, an empty audit and the digest of nothing. Other
    columns are ignored, whatever their names; an empty table gives an empty result.

    The cost runs over an automaton of four states; a block of ``block`` rows is a matrix,
    and matrices of blocks are multiplied in groups of ``fan_out``, so a conversation of any
    length is shared by many tasks.
    """
    source = conversations.select(*[quoted(c).alias(c) for c in ("conv_id", "turn", "role", "text")])
    ordered, edits, figures = plan_repairs(damage(source), block, fan_out)
    costs = edits.filter("cost IS NOT NULL").select("conv", "cost")
    every = source.select(_key(F.col("conv_id")).alias("conv"), "conv_id").distinct()
    joined = every.join(figures, "conv", "left").join(costs, "conv", "left").join(digests(ordered, edits), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))
