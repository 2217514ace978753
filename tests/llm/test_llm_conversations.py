"""Conversation repair against all edit scripts, and its blocks against one block."""

import hashlib
import itertools
import random
import re
import zlib

from lanewise.llm import conversations as conv

ROWS = "conv_id long, turn long, role string, text string"


def faults(rows):
    """blank, duplicate, truncated or None of each row of (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(conv.BLANKS)
        out.append(
            "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        )
        seen.add((role, text))
    return out


def slow_repair(rows):
    """Cheapest (cost, audit, repaired) over every script of a few rows."""
    found, marks = [], faults(rows)
    gaps = ["", "I", "II"]
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(m in ("blank", "duplicate") and e != "D" for m, e in zip(marks, edits)):
            continue
        for spots in itertools.product(gaps, repeat=len(rows) + 1):
            audit = "".join(s + e for s, e in zip(spots, [*edits, ""]))
            left, initials, said, cost = iter(zip(rows, marks)), "", [], 0
            for e in audit:
                row, mark = next(left) if e != "I" else (("", ""), None)
                cost += {"K": 0, "D": 3, "R": 2, "I": 2}[e] + (mark == "truncated" and e != "D")
                if e == "D":
                    continue
                role = row[0] if e == "K" else "assistant" if initials[-1:] == "u" else "user"
                initials += role[:1] or "?"
                said.append(f"{role}:{row[1]}")
            if re.fullmatch("(s?(ua)+)?", initials):
                found.append((cost, audit, "\n".join(said)))
    return min(found)


def test_every_script_of_small_conversations(spark):
    r = random.Random(3)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["a.", "b", "c!", " ", None, "a."]
    groups = {k: [(r.choice(roles), r.choice(texts)) for _ in range(r.randint(1, 4))] for k in range(60)}
    rows = [(k, t, *row) for k, group in groups.items() for t, row in enumerate(group)]
    shown = [(c, t, role, text, 5) for c, t, role, text in rows]
    r.shuffle(shown)
    table = spark.createDataFrame(shown, ROWS + ", audit int")
    for size in (1, 2, 65536):
        got = {g["conv_id"]: g for g in conv.repair_report(table, block_rows=size).collect()}
        assert len(got) == len(groups)
        for k, group in groups.items():
            plain = [(a if a is not None else " ", b if b is not None else " ") for a, b in group]
            cost, audit, said = slow_repair(plain)
            marks = faults(plain)
            pairs = [a[0][:1] + b[0][:1] for a, b in zip(plain, plain[1:])]
            want = (cost, audit, hashlib.sha256(said.encode()).hexdigest(), 0, sum(p not in ("su", "ua", "au") for p in pairs))
            assert want == tuple(got[k][c] for c in ("cost", "audit", "repaired_sha256", "gaps", "illegal"))
            assert [marks.count(m) for m in ("blank", "duplicate", "truncated")] == [got[k][m] for m in ("blank", "duplicate", "truncated")]


def test_blocks_do_not_change_a_long_conversation(spark):
    r = random.Random(4)
    rows = [(1, t if t % 7 else None, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "c?", ""]) + str(t % 50) + r.choice([".", ""])) for t in range(3000)]
    rows += [(2, 5, "user", "Same.")] * 500 + [(None, 1, "user", "x.")]
    table = spark.createDataFrame(rows, ROWS).repartition(7)
    want = None
    for size in (7, 1000, 65536):
        got = sorted(conv.plan_edits(table, block_rows=size).collect(), key=repr)
        assert want is None or got == want
        want = got
    by = {g["conv_id"]: g for g in want}
    assert by[2]["audit"] == "K" + "D" * 499 + "I"
    assert (by[2]["duplicate"], by[2]["gaps"], by[2]["cost"]) == (499, 0, 499 * 3 + 2)
    assert by[None]["audit"] == "KI" and by[1]["gaps"] == 2996 // 7  # the turns that are null


def test_repaired_rows_and_ids_without_rows(spark):
    rows = [(1, 2, "assistant", "Yes."), (1, 0, "system", "Be kind."), (1, 1, "user", "Well?"), (2, 0, "assistant", "Hi")]
    table, everyone = spark.createDataFrame(rows, ROWS), spark.createDataFrame([(1,), (2,), (3,), (None,)], "conv_id long")
    edits = conv.plan_edits(table, everyone)
    by = {e["conv_id"]: (e["audit"], e["cost"]) for e in edits.collect()}
    assert by == {1: ("KKK", 0), 2: ("D", 3), 3: ("", 0), None: ("", 0)}
    got = sorted(tuple(g) for g in conv.repaired(table, edits, deleted=True).where("conv_id = 1").collect())
    assert got == [(1, 0, "K", "system", "Be kind."), (1, 1, "K", "user", "Well?"), (1, 2, "K", "assistant", "Yes.")]
    digests = {d["conv_id"]: d["repaired_sha256"] for d in conv.repaired_digests(table, edits).collect()}
    assert digests[3] == digests[None] == digests[2] == hashlib.sha256(b"").hexdigest()
    none = table.limit(0)
    assert conv.repair_report(none).count() == 0 and conv.repaired(none, conv.plan_edits(none)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    got = sorted(map(tuple, conv.damaged(spark.createDataFrame(rows, ROWS)).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
        want += [(c, t, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    assert got == sorted(want, key=repr)
