"""Conversation repair: the cheapest edits that give ``system? (user assistant)*``, by Hirschberg.

Rows become one byte each (role and fault). A conversation's bytes are cut into blocks of bounded
length, wherever a task's share of the sorted rows ends or a block is full, so that a conversation
of any length is spread over tasks. A block is summarised by what crossing it costs between each
pair of the four states; the blocks of a conversation, and then the bytes of each block, are
solved by the same divide and conquer: a forward and a backward vector of four costs meet in the
middle, the audit-least of the cheapest crossings is fixed, and both halves follow.

Texts are moved once, to be replayed in order along the finished edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.session import stored

BLANKS = " \t\n\x0b\x0c\r"

# States: nothing said yet, after system, after user, after assistant.
EMPTY, SYSTEM, USER, ASSISTANT = STATES = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
NEVER = float("inf")
MUST_DELETE, TRUNCATED = 4, 8

#: Cost and edits that finish a conversation from each state.
CLOSING = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]


def following(state: int) -> int:
    """The state after the one role that may be inserted or given in this state."""
    return ASSISTANT if state == USER else USER


def after(state: int, role: int) -> int | None:
    """The state after a row that keeps its role, or None where that role is out of place."""
    if role == SYSTEM:
        return SYSTEM if state == EMPTY else None
    return role if role and role == following(state) else None


def row_moves(code: int) -> list[list[tuple]]:
    """For each state the (next state, cost, edits) of one row, the best for each next state.

    At most one insertion comes before an edit: two lead to a state that the edit alone reaches
    too, and an insertion before a deletion reads better (D before I) after it.
    """
    role, extra, out = code & 3, bool(code & TRUNCATED), []
    for state in STATES:
        best = {state: (DELETE, "D")}
        if not code & MUST_DELETE:
            for start, cost, word in ((state, 0, ""), (following(state), INSERT, "I")):
                ends = ((after(start, role), KEEP, "K"), (following(start), REROLE, "R"))
                for end, more, edit in ends:
                    if end is not None:
                        found = (cost + more + extra, word + edit)
                        best[end] = min(best.get(end, found), found)
        out.append([(end, *found) for end, found in best.items()])
    return out


MOVES = [row_moves(code) for code in range(16)]
WORDS = [[{end: word for end, _, word in state} for state in moves] for moves in MOVES]


def forward(moves: list, start: int) -> tuple[list, list[int]]:
    """Least cost of reaching each state, and the order of the least audits that reach them.

    The audits of different states differ and none begins another, since an audit fixes its
    roles and ends with the edit of a row. Their order is therefore all that later steps need.
    """
    cost, order = [NEVER] * 4, [0] * 4
    cost[start] = 0
    for states in moves:
        best: list = [None] * 4
        for state in STATES:
            if cost[state] < NEVER:
                for end, more, word in states[state]:
                    found = (cost[state] + more, order[state], word)
                    if best[end] is None or found < best[end]:
                        best[end] = found
        reached = sorted((s for s in STATES if best[s] is not None), key=lambda s: best[s][1:])
        cost, order = [NEVER if b is None else b[0] for b in best], [0] * 4
        for k, state in enumerate(reached):
            order[state] = k
    return cost, order


def backward(moves: list, last: list) -> list:
    """Least cost from each state to the end, where ``last`` is the cost of each end state."""
    for states in reversed(moves):
        last = [min((more + last[end] for end, more, _ in state), default=NEVER) for state in states]
    return last


def crossings(moves: list, start: int, last: list) -> list[int]:
    """The state after each move of the cheapest, audit-least way; moves of one row or one block."""
    out, todo = [], [(0, len(moves), start, last)] if moves else []
    while todo:
        low, high, start, last = todo.pop()
        if high - low == 1:
            found = min((more + last[end], word, end) for end, more, word in moves[low][start])
            out.append(found[2])
            continue
        middle = (low + high) // 2
        cost, order = forward(moves[low:middle], start)
        rest = backward(moves[middle:high], last)
        meet = min(STATES, key=lambda s: (cost[s] + rest[s], order[s]))
        todo.append((middle, high, meet, last))
        todo.append((low, middle, start, [0 if s == meet else NEVER for s in STATES]))
        # The left half is on top, so states come out from left to right.
    return out


def edits_of(codes: bytes, start: int, end: int | None = None) -> str:
    """The audit of the rows: to a given state, or to the end of the conversation."""
    last = [cost for cost, _ in CLOSING] if end is None else [0 if s == end else NEVER for s in STATES]
    words, state = [], start
    for code, then in zip(codes, crossings([MOVES[c] for c in codes], start, last)):
        words.append(WORDS[code][state][then])
        state = then
    return "".join(words) + (CLOSING[state][1] if end is None else "")


def block_moves(codes: bytes) -> list[list[tuple]]:
    """Like ``row_moves`` for a whole block; the order of the audits stands for the edits."""
    moves, out = [MOVES[c] for c in codes], []
    for state in STATES:
        cost, order = forward(moves, state)
        out.append([(end, cost[end], order[end]) for end in STATES if cost[end] < NEVER])
    return out


def _facts(rows: DataFrame, everyone: DataFrame | None) -> DataFrame:
    """One row per different (conv_id, turn, role, text): how often, whether blank or cut off."""
    bare = F.rtrim("text", F.lit(BLANKS))
    facts = rows.select(
        "conv_id", "turn", "role", "digest", F.lit(1).alias("present"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    if everyone is not None:
        marker = everyone.select("conv_id").distinct()
        missing = [F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in ("turn", "role", "digest")]
        facts = facts.union(
            marker.select("conv_id", *missing, F.lit(0), F.lit(False), F.lit(False))
        )
    return facts.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("present").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut")
    )


def _rows(conversations: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    ).withColumn("digest", F.md5(F.encode("text", "UTF-8")))


SUMMARY = (
    "part int, seq int, rows long, blank long, duplicate long, truncated long, illegal long, "
    "first int, last int, low long, high long, turns long, moves array<array<struct<end:int,cost:long,audit:int>>>"
)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _blocks(ordered: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of the sorted facts: a byte per row, and the block's summary."""
    schema = f"conv_id {ordered.schema['conv_id'].dataType.simpleString()}, codes binary, {SUMMARY}"
    kind = _arrow(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, seq = TaskContext.get().partitionId(), 0
        conv, codes, totals, turns = None, bytearray(), [0, 0, 0], []

        def block():
            nonlocal seq
            roles = np.frombuffer(bytes(codes), np.uint8) & 3
            a, b = roles[:-1], roles[1:]
            good = ((a != USER) & (a > 0) & (b == USER)) | ((a == USER) & (b == ASSISTANT))
            seq += 1
            return {
                "conv_id": conv, "codes": bytes(codes), "part": part, "seq": seq, "rows": len(codes),
                "blank": totals[0], "duplicate": totals[1], "truncated": totals[2],
                "illegal": int((~good).sum()),
                "first": int(roles[0]) if len(roles) else None, "last": int(roles[-1]) if len(roles) else None,
                "low": turns[0] if turns else None, "high": turns[1] if turns else None, "turns": turns[2] if turns else 0,
                "moves": [[dict(zip(("end", "cost", "audit"), m)) for m in state] for state in block_moves(bytes(codes))],
            }

        open_block = False
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "blank", "cut", "later"))):
                name, turn, role, n, blank, cut_off, later = row
                if open_block and name != conv:
                    out.append(block())
                if not open_block or name != conv:
                    conv, codes, totals, turns, open_block = name, bytearray(), [0, 0, 0], [], True
                code = INITIALS.get((role or "")[:1], 0)
                first = code | (MUST_DELETE if blank or later else TRUNCATED if cut_off else 0)
                for value, times in ((first, min(n, 1)), (code | MUST_DELETE, n - 1)):
                    while times > 0:
                        if len(codes) == block_rows:
                            out.append(block())
                            codes, totals, turns = bytearray(), [0, 0, 0], []
                        take = min(times, block_rows - len(codes))
                        codes += bytes([value]) * take
                        fault = 0 if blank else 1 if value & MUST_DELETE else 2 if value & TRUNCATED else None
                        if fault is not None:
                            totals[fault] += take
                        if turn is not None:
                            if not turns:
                                turns = [turn, turn, 1]
                            elif turn != turns[1]:
                                turns = [turns[0], turn, turns[2] + 1]
                        times -= take
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)
        if open_block:
            yield pa.RecordBatch.from_pylist([block()], kind)

    return ordered.mapInArrow(cut, schema)


TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _join_blocks(left: dict, right: dict) -> dict:
    """The counts of two neighbouring runs of blocks."""
    out = {c: left[c] + right[c] for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    pair = (left["last"], right["first"])
    if None not in pair and pair not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
        out["illegal"] += 1
    if left["high"] is not None and left["high"] == right["low"]:
        out["turns"] -= 1
    for c, sides in (("first", (left, right)), ("low", (left, right)), ("last", (right, left)), ("high", (right, left))):
        out[c] = sides[0][c] if sides[0][c] is not None else sides[1][c]
    return out


def _fold(blocks: DataFrame) -> DataFrame:
    """For each block the states it starts and ends with, and its conversation's totals.

    The blocks of one conversation meet in one task: an audit is a string of less than 2^31
    letters, so there are at most 2^31 / block_rows full ones, each a summary of some hundred bytes.
    """
    name = blocks.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {name}, part int, seq int, start int, end int, closing string, {TOTALS}"
    kind = _arrow(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(b.to_pylist() for b in batches)
        out = []
        for conv, group in groupby(rows, key=itemgetter("conv_id")):
            mine = list(group)
            moves = [[[tuple(m.values()) for m in state] for state in block["moves"]] for block in mine]
            ends = crossings(moves, EMPTY, [cost for cost, _ in CLOSING])
            total = reduce(_join_blocks, mine)
            cost, start = CLOSING[ends[-1]][0], EMPTY
            for states, end in zip(moves, ends):
                cost += min(more for e, more, _ in states[start] if e == end)
                start = end
            totals = {c: total[c] for c in ("blank", "duplicate", "truncated", "illegal")}
            totals["gaps"] = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
            start = EMPTY
            for block, end in zip(mine, ends):
                closing = CLOSING[end][1] if block is mine[-1] else ""
                out.append({"conv_id": conv, "part": block["part"], "seq": block["seq"], "start": start, "end": end, "closing": closing, "cost": cost, **totals})
                start = end
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out = []
        yield pa.RecordBatch.from_pylist(out, kind)

    ordered = blocks.drop("codes").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return ordered.mapInArrow(fold, schema)


def plan_edits(
    conversations: DataFrame, everyone: DataFrame | None = None, block_rows: int = 65536
) -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    ``conversations`` holds ``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored.
    Rows are taken by turn, nulls first, then role and the text's md5. A null role or text counts as
    one space; rows with a null ``conv_id`` are one conversation. A row's first fault counts: blank,
    duplicate (an earlier row has its role and text; so all but one of repeated rows), truncated (the
    last character other than blanks is no ``.``, ``!`` or ``?``). ``audit`` has one letter per edit
    in order: K keeps a row, R gives it the role of its place, D deletes it (blank and duplicate rows
    must go), I inserts an empty row. Costs are 0, 2, 3, 2, and 1 for each truncated row that stays.
    Ids of ``everyone`` without rows have zeros and an empty audit. Empty tables give no rows.
    Results do not depend on ``block_rows``.
    """
    facts = stored(_facts(_rows(conversations), everyone), "turns")
    first = (
        facts.where("n > 0").groupBy("conv_id", "role", "digest")
        .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns"))
        .where("turns > 1")
    )
    a, b = facts.alias("a"), first.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    later = F.coalesce(F.col("b.turns") > 1, F.lit(False)) & ~F.col("a.turn").eqNullSafe(F.col("b.first.turn"))
    marked = a.join(b, same, "left").select("a.*", later.alias("later"))
    order = ["conv_id", "turn", "role", "digest"]
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stored(_blocks(ordered, block_rows), "blocks")
    solved = _fold(blocks)
    schema = f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}, part int, seq int, edits string, {TOTALS}"
    kind = _arrow(schema)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["edits"] = edits_of(row["codes"], row["start"], row["end"]) + row["closing"]
            yield pa.RecordBatch.from_pylist([{c: row[c] for c in kind.names} for row in rows], kind)

    spelled = blocks.select("part", "seq", "codes").join(solved, ["part", "seq"]).mapInArrow(spell, schema)
    totals = [c.split()[0] for c in TOTALS.split(", ")]
    pieces = F.array_sort(F.collect_list(F.struct("part", "seq", "edits")))
    return spelled.groupBy("conv_id").agg(
        *[F.first(c).alias(c) for c in totals],
        F.array_join(F.transform(pieces, lambda p: p["edits"]), "").alias("audit"),
    )


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, None) at a conversation's start, then (conv_id, (edit, role, text)) of its edits."""
    roles = {USER: "user", ASSISTANT: "assistant"}
    conv, audit, at, state = None, "", 0, EMPTY

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, following(state)
            yield conv, ("I", roles[state], "")

    for batch in batches:
        for name, plan, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "plan", "role", "text"))):
            if plan is not None:
                yield from inserted()
                conv, audit, at, state = name, plan, 0, EMPTY
                yield conv, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = INITIALS[role[:1]]
            elif edit == "R":
                state = following(state)
                role = roles[state]
            yield conv, (edit, role, text)
    yield from inserted()


def _stream(conversations: DataFrame, edits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, in one task."""
    rows, text = _rows(conversations), F.lit(None).cast("string")
    rows = rows.select("conv_id", text.alias("plan"), "turn", "role", "text", "digest")
    plans = edits.select("conv_id", F.col("audit").alias("plan"), F.lit(None).cast("long"), text, text, text)
    order = [F.col("conv_id"), F.col("plan").isNull(), F.col("turn"), F.col("role"), F.col("digest")]
    return plans.toDF(*rows.columns).union(rows).repartition("conv_id").sortWithinPartitions(*order).drop("turn", "digest")


def repaired(conversations: DataFrame, edits: DataFrame, deleted: bool = False) -> DataFrame:
    """``conv_id``, ``place``, ``edit``, ``role``, ``text``: the rows after the edits, in order from 0.

    With ``deleted`` the rows that go are listed too, with a null place. ``edits`` is the result of
    ``plan_edits`` for the same rows. Rows are streamed; only a conversation's audit is held.
    """
    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, place long, edit string, role string, text string"
    kind = _arrow(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, size = [], 0, 0
        for conv, row in _replay(batches):
            if row is None:
                place = 0
                continue
            edit, role, text = row
            if edit != "D" or deleted:
                out.append({"conv_id": conv, "place": None if edit == "D" else place, "edit": edit, "role": role, "text": text})
                size += len(text)
            place += edit != "D"
            if len(out) >= 4096 or size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, kind)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, kind)

    return _stream(conversations, edits).mapInArrow(write, schema)


def repaired_digests(conversations: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id``, ``repaired_sha256``: lower-case hex of the newline-joined ``role:text`` rows.

    A hash of one text is read from its start to its end, so one task reads one conversation; it
    streams the rows and holds none of them.
    """
    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    kind = _arrow(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, state, first = [], None, None, True
        for name, row in _replay(batches):
            if row is None:
                if state is not None:
                    out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                conv, state, first = name, hashlib.sha256(), True
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out = []
            elif row[0] != "D":
                state.update(f"{'' if first else chr(10)}{row[1]}:{row[2]}".encode("utf-8", "surrogatepass"))
                first = False
        if state is not None:
            out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, kind)

    return _stream(conversations, edits).mapInArrow(digest, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults for trials, by crc32 of ``conv_id:turn`` modulo 20; nulls become one space.

    0 drops a row, 1 empties its text, 2 removes ``.``, ``!`` and ``?`` from it, 3 repeats it, 4 sets its role to user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = (F.crc32(F.encode(key, "UTF-8")) % 20).alias("fault")
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault).where("fault <> 0")
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def repair_report(conversations: DataFrame, everyone: DataFrame | None = None, block_rows: int = 65536) -> DataFrame:
    """``plan_edits`` with ``repaired_sha256``: all that is known of each conversation's repair."""
    edits = stored(plan_edits(conversations, everyone, block_rows), "edits")
    digests = repaired_digests(conversations, edits)
    same = edits["conv_id"].eqNullSafe(digests["conv_id"])
    return edits.join(digests, same).select(edits["*"], "repaired_sha256")
